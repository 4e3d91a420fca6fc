"""Entity resolution between kinds of documents, spread over their members: against all pairs, and without shuffling pairs."""

import itertools
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from cairn.functions import kernels
from cairn.operators import resolution

DOC = "concept_id string, type string, type_alternative string, title string, key string"
WORDS = ["stoic", "stoicism", "cats", "carts", "run", "ruin", "abc", "axbxc", "apple", "beta", "cup", "of", "diet", "tide", "agent", "agents"]


def made(seed, n=70, shared=6):
    """Documents with few kinds, blank and equal alternative types, one row twice, and some ids that stand for several documents."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        title = rnd.choice(["apple beta cup", "run abc", " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 4)))])
        out.append((f"d{rnd.randrange(shared) if i < 2 * shared else i:03d}", rnd.choice("PQR"), rnd.choice([None, " ", "P", "Q ", "R"]), title, title))
    return [*out, out[-1]]


def lane_pairs(docs):
    """Both documents of each pair that is compared, the lesser id first, and the label of their types."""
    other = lambda d: (d[2] or "").strip()
    for a, b in itertools.permutations(set(docs), 2):
        bridge = lambda x, y: other(x) not in ("", x[1]) and other(x) == y[1]
        if a[0] < b[0] and (a[1] == b[1] or bridge(a, b) or bridge(b, a)):
            yield a, b, "+".join(sorted({a[1], b[1]}))


def brute(docs):
    acronyms, near = {}, set()
    for a, b, label in lane_pairs(docs):
        if m := kernels.acronym_match(a[4], b[4]):
            acronyms[label, a[0], b[0]] = min(m, acronyms.get((label, a[0], b[0]), m))
        if a[4] != b[4] and (s := kernels.near_match(a[4], b[4])) is not None:
            near.add((label, a[0], b[0], round(s, 6)))
    return acronyms, near


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_report_equal_all_pairs(spark, seed):
    docs = made(seed)
    df = spark.createDataFrame(docs, DOC)
    acronyms, near = brute(docs)
    got = [tuple(r) for r in resolution.acronym_pairs(df, bridged=True).collect()]
    assert acronyms and sorted(got) == sorted((*k, v) for k, v in acronyms.items())
    assert near and sorted(tuple(r) for r in resolution.near_pairs(df, bridged=True).collect()) == sorted(near)
    bridges = {tuple(sorted((a[0], b[0]))) for a, b in itertools.permutations(docs, 2) if a[0] != b[0] and a[2] and a[2] != a[1] and a[2] == b[1]}
    assert sorted(tuple(r) for r in resolution.bridge_pairs(df).collect()) == sorted(bridges)

    groups = [(0, 0.0, r["member_types"], r["member_ids"]) for r in resolution.same_title(df).collect()]
    groups = [(t, s, "+".join(sorted(set(types))), m) for t, s, types, m in groups]
    groups += [(1, 0.0, label, [a, b]) for label, a, b in acronyms]
    hit = {k[1:] for k in acronyms}
    groups += [(2, -float(Decimal(str(s)).quantize(Decimal("0.001"), ROUND_HALF_UP)), label, [a, b]) for label, a, b, s in near if (a, b) not in hit]
    groups.sort()
    for cap in (5, len(groups) // 2, len(groups) + 9):
        rows = resolution.report(df, cap).collect()
        tiers = {"HIGH": 0, "ACRONYM": 1, "LOW": 2}
        assert {r["produced"] for r in rows} == {len(groups)}
        assert [(r["type"], tiers[r["tier"]], r["member_ids"]) for r in rows] == sorted((label, t, m) for t, _, label, m in groups[:cap])


def test_scores_that_depend_on_the_order_are_counted_and_ranked(spark, monkeypatch):
    """A likeness found in one order only: of the members' pairs, those in that order count."""
    ids = list(range(40))
    random.Random(5).shuffle(ids)
    docs = [(f"d{i:02d}", "P", None, w, w) for n, i in enumerate(ids) for w in [("diet", "tide")[n % 3 == 0]]]
    df = spark.createDataFrame(docs, DOC)
    kinds = resolution._kinds_as_docs(resolution._titled(df)).orderBy("key").collect()
    one_way = spark.createDataFrame([("P", kinds[0][0], kinds[1][0], None, 0.8)], "type string, k1 struct<type:string,type_alternative:string,key:string>, k2 struct<type:string,type_alternative:string,key:string>, s12 double, s21 double")
    monkeypatch.setattr(resolution, "_near_kinds", lambda docs, bridged: one_way)
    tide, diet = (sorted(d[0] for d in docs if d[3] == w) for w in ("tide", "diet"))
    want = sorted([a, b] for a in tide for b in diet if a < b)
    assert sorted([r["id_a"], r["id_b"]] for r in resolution.near_pairs(df).collect()) == want
    for cap in (3, 50):
        rows = [r for r in resolution.report(df, cap).collect() if r["tier"] == "LOW"]
        assert [r["member_ids"] for r in rows] == want[: cap - 2] and {r["produced"] for r in rows} == {len(want) + 2}


def shuffled(spark, run):
    """run() and how many records its stages wrote to shuffles."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        held = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {held.apply(i).stageId(): held.apply(i).shuffleWriteRecords() for i in range(held.size())}
    before = stages()
    out = run()
    return out, sum(n for i, n in stages().items() if i not in before)


def many(n=600):
    """Two kinds of n documents each, which match by acronym, by likeness or by bridge."""
    return {
        "acronym_pairs": [(f"c/{i}", "P", None, t, t) for i in range(2 * n) for t in [("tool abc", "alpha beta cup")[i % 2]]],
        "near_pairs": [(f"c/{i}", "P", None, t, t) for i in range(2 * n) for t in [("old ring", "cold ring")[i % 2]]],
        "bridge_pairs": [(f"c/{i}", "PQ"[i % 2], (None, "P")[i % 2], "x", "x") for i in range(2 * n)],
    }


@pytest.mark.parametrize("name", ["acronym_pairs", "near_pairs", "bridge_pairs"])
def test_pairs_of_many_members_are_not_shuffled(spark, name):
    df = spark.createDataFrame(many()[name], DOC)
    rows, moved = shuffled(spark, lambda: getattr(resolution, name)(df).collect())
    assert len({(r["id_a"], r["id_b"]) for r in rows}) == len(rows) == 600 * 600
    assert moved < 30_000


def test_report_counts_pairs_without_writing_them(spark):
    docs = many()["near_pairs"]
    rows, moved = shuffled(spark, lambda: resolution.report(spark.createDataFrame(docs, DOC), 10).collect())
    assert {r["produced"] for r in rows} == {600 * 600 + 2} and len(rows) == 10
    a, b = (sorted(d[0] for d in docs if d[3] == w) for w in ("old ring", "cold ring"))
    assert [r["member_ids"] for r in rows if r["tier"] == "LOW"] == sorted(sorted(p) for p in itertools.product(a, b))[:8]
    assert moved < 50_000


def test_near_pairs_of_two_large_kinds_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    docs = [(f"c/{i}", "P", None, t, t) for i in range(10_600) for t in ["cold ring" if i < 600 else "old ring"]]
    held = resolution.near_pairs(spark.createDataFrame(docs, DOC)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 6_000_000 and max(r["count"] for r in held) < 4_500_000

"""Each operator against brute force on small fixtures, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from cairn.llm import chat, cover_tree, jaccard, katz, line_dedup, mixing, pii, quality, queries, token_counts, tokenize
from cairn.llm.bpe import Encoder, Utf8Stream, decode_stream, load_ranks
from cairn.llm.common import word_hashes

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
DATA = open(RANKS, "rb").read()
WORD = re.compile(r"[^ \t-\r]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "of", "and", "tion", "alpha", "beta", "gamma", "delta"]) + rnd.choice(["", "x", "yy", "zz"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    base = [prose(rnd, n) for n in (3, 4, 5, 6, 60, 80, 120, 300, 700)]
    near = []
    for t in base[4:]:
        w = t.split()
        for k in range(4):
            v = list(w)
            for _ in range(k):
                v[rnd.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    return base + near + ["", " \n\t", "One\x0btwo", "a", "A", "émigré 日本 x", base[5], base[5].upper()]


def rows(texts):
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (None, texts[5], None, None, 3)]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), DOCS)


def test_word_hashes_split_and_fold_as_the_contract():
    texts = ["A b\x0bC", None, "", "  x ", "a B c"]
    h, at = word_hashes([t.encode() if t else None for t in texts])
    assert at.tolist() == [0, 3, 3, 3, 4, 7]
    assert h[0] == h[4] and h[1] == h[5] and h[2] == h[6] and len(set(h.tolist())) == 4


# 1


def brute_lines(docs, min_words):
    seqs = [[(i, x, len(WORD.findall(x))) for i, x in enumerate(t.split("\n")) if WORD.search(x)] for t in docs]
    best, n = {}, 1
    while True:
        first, count = {}, Counter()
        for d, s in enumerate(seqs):
            for p in range(len(s) - n + 1):
                key = tuple(x[1] for x in s[p : p + n])
                count[key] += 1
                first.setdefault(key, (d, p))
        if not any(c > 1 for c in count.values()):
            break
        for d, s in enumerate(seqs):
            for p in range(len(s) - n + 1):
                src = first[tuple(x[1] for x in s[p : p + n])]
                if src != (d, p):
                    best[d, p] = (n, src)
        n *= 2
    runs = defaultdict(list)
    for (d, p), (n, (sd, sp)) in sorted(best.items()):
        held = runs[d, sd, sp - p]
        if held and p <= held[-1][1]:
            held[-1][1] = max(held[-1][1], p + n)
        else:
            held.append([p, p + n])
    gone = defaultdict(set)
    for (d, _, _), held in runs.items():
        for a, b in held:
            if sum(x[2] for x in seqs[d][a:b]) >= min_words:
                gone[d] |= {x[0] for x in seqs[d][a:b]}
    return [sorted(gone[d]) for d in range(len(docs))]


@pytest.mark.parametrize("min_words", [1, 3])
def test_line_dedup_equals_brute_force(spark, min_words):
    rnd = random.Random(3)
    lines = ["a", "b b", "c c c", "d", "e e", "", "  "]
    docs = ["\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 14))) for _ in range(25)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_runs int")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, min_words).collect()}
    want = brute_lines(docs, min_words)
    for i, t in enumerate(docs):
        assert list(got[i]["deleted_lines"]) == want[i], (i, t)
        assert got[i]["text"] == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i])


def test_line_dedup_edges(spark):
    one = "x " * 12 + "\nlast"
    df = spark.createDataFrame([(1, one), (1, one), (2, one), (None, one), (3, None), (4, "")], "doc_id long, text string")
    got = line_dedup.dedup_lines(df).collect()
    assert sorted((str(r["doc_id"]), tuple(r["deleted_lines"])) for r in got) == [("1", ()), ("1", ()), ("2", (0, 1)), ("3", ()), ("4", ()), ("None", ())]
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def brute_longest(docs, min_words):
    """Lines within a longest earlier match of min_words words or more."""
    seqs = [[(i, x, len(WORD.findall(x))) for i, x in enumerate(t.split("\n")) if WORD.search(x)] for t in docs]
    places = [(d, p) for d, s in enumerate(seqs) for p in range(len(s))]
    gone = [set() for _ in docs]
    for d, p in places:
        s = seqs[d][p:]
        best = max((sum(1 for _ in itertools.takewhile(lambda x: x[0][1] == x[1][1], zip(s, seqs[e][q:], strict=False))) for e, q in places if (e, q) < (d, p)), default=0)
        if sum(x[2] for x in s[:best]) >= min_words:
            gone[d] |= {x[0] for x in s[:best]}
    return [sorted(x) for x in gone]


@pytest.mark.parametrize("min_words", [1, 3, 4, 7, 10])
def test_whole_line_runs_equal_longest_earlier_matches(spark, min_words):
    rnd = random.Random(min_words)
    lines = ["a", "b b", "c c c", "d", "e e", "f f f f f f f f", "", "  "]
    docs = ["\n".join(rnd.choice(lines[: rnd.randrange(2, 9)]) for _ in range(rnd.randrange(0, 18))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, min_words, whole=True).collect()}
    for i, want in enumerate(brute_longest(docs, min_words)):
        assert list(got[i]["deleted_lines"]) == want, (i, docs[i])
        worded = [j for j, x in enumerate(docs[i].split("\n")) if WORD.search(x)]
        assert got[i]["n_runs"] == sum(j in want and (n == 0 or worded[n - 1] not in want) for n, j in enumerate(worded))


def test_registered_line_dedup_finds_runs_of_several_sources(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(4)) for x in "abc")
    data = [(1, f"{b}\n{c}"), (2, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, "\n".join(["w x y z"] * 4))]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (list(r["deleted_lines"]), r["n_runs"]) for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: ([], 0), 2: ([], 0), 3: ([0, 1, 2], 1), 4: ([1, 2, 3], 1)}


# 2


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e12])
def test_top_k_equals_brute_force(spark, scale):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(300, 8)) * scale
    x[100:160] = x[100]
    data = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [1.0, None] + [0.0] * 6), (440, [float("nan")] * 8), (460, [1.0, 2.0]), (480, [3.0, 1.0]), (500, [])]
    data += [data[20], (None, data[20][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in cover_tree.top_k(df, k=7, block_rows=64, chunk_rows=4, sample=50).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(64 * c) for c in v] for i, v in data if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    assert set(got) == {q for q in whole if q % 20 == 0 and any(len(whole[v]) == len(whole[q]) for v in whole if v != q)}
    for q in got:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:7]
        top = 2**63 - 1
        assert [(v, s) for _, v, s in sorted(got[q])] == [(i, max(min(-s, top), -top)) for s, i in scored] or scale > 1e9


def test_top_k_of_nothing(spark):
    assert cover_tree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_top_k_with_an_empty_home_block(spark):
    data = [(20 * d + i, [1.0 + i] * d) for d in range(2, 14) for i in range(2)] * 40
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r["query_id"]: (r["rank"], r["vec_id"], r["score"]) for r in cover_tree.top_k(df, block_rows=20).collect()}
    assert got == {20 * d: (1, 20 * d + 1, 64 * 128 * d) for d in range(2, 14)}


def test_dual_tree_prunes_clustered_data():
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.integers(-3, 4, (500, 6)) + c for c in (200, -200)]).astype(float)
    ids = np.arange(len(x))
    best = cover_tree.Best(ids[:20], 5)
    done = cover_tree.dual_search(x[:20], cover_tree.build(x[:20], 8), x, ids, cover_tree.build(x, 50), best)
    want = [sorted((-int(x[i] @ x[j]), j) for j in range(len(x)) if j != i)[:5] for i in range(20)]
    assert [[(-int(s), int(v)) for s, v in zip(a, b, strict=True)] for a, b in zip(best.scores, best.found, strict=True)] == want
    assert done < 20 * len(x)


# 3


def brute_stats(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), dup, len(covered)


def test_statistics_equal_brute_force(spark, texts):
    rnd = random.Random(9)
    extra = ["a b c a b c", "a a a a", "x y", "a\na\n\n\nb\na", "# $ a|b\n<x>", " ".join(rnd.choice("abc") for _ in range(400)), " ".join(str(i % 90) for i in range(300))]
    df = frame(spark, texts + extra).withColumnRenamed("lang", "kept")
    got = quality.apply_rules(df, quality.DecisionList(())).collect()
    for r in got:
        s, want = r["stats"], brute_stats(r["text"])
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == want, r["text"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_rules_are_learned_and_leave_the_good_alone(spark):
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"w{rnd.randrange(5000)}" + ("###" if bad and rnd.random() < 0.8 else "") for _ in range(120)]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    d, n = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 0), (5, None)], "doc_id long, quality int")
    rules = quality.fit(d, n)
    assert rules.rules
    kept = {r["doc_id"]: r["kept"] for r in quality.apply_rules(d, rules).collect()}
    assert sum(kept[i] for i, q in labels if q == 1) >= 298 and sum(kept[i] for i, q in labels if q == 0) <= 2
    assert quality.fit(d, n.limit(0)).rules == ()
    plan = quality.apply_rules(d, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 4


def test_patterns_equal_plain_regexes():
    rnd = random.Random(2)
    alphabet = ["@", ".", "-", "+", " ", "(", ")", "a", "B", "1", "23", "456", "4111111111111111", "256", "0", "x@y.z", "1.2.3.4", "é", "\n", "+1 (555) 555-0100", "%"]

    def plain(t):
        out = []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
            out.append((m.start(), m.end(), 0))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
            if all(int(x) <= 255 for x in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
                out.append((m.start(), m.end(), 2))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
        return sorted(out, key=lambda s: (s[0], s[2]))

    for _ in range(4000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 14)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("a" * 200_000 + "9" * 200_000) == []


def test_field_adds_alike_tokens_and_keeps_base(spark):
    seen = [f"call +1 (555) 555-0{i:03d} or mail u{i}.x@mail{i % 9}.example.com at 10.0.{i % 250}.7 room {i}" for i in range(200)]
    model = pii.train(seen)
    text = "card 4111-1111-1111-1111 then again 4111/1111/1111/1111 and 3. or 4.0."
    model2 = pii.train(seen + ["pay 4111-1111-1111-1111 now 12"] * 50)
    base, spans = pii.find(text, model2)
    assert set(base) <= set(spans) and [k for _, _, k in base] == [2]
    docs = spark.createDataFrame([(1, seen[0], "x"), (1, seen[0], "x"), (2, None, None), (3, "", ""), (4, "no data", "")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs, model).collect()}
    assert (got[1]["n_email"], got[1]["n_phone"], got[1]["n_ip"]) == (1, 1, 1)
    want = pii.show(pii.base_spans(seen[0]))
    assert got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(got[1]["spans"].split(","))
    assert got[2]["spans"] == "" == got[4]["spans"]
    assert pii.find_personal_data(docs.limit(0), model).collect() == []


def test_messages_are_exact_on_a_tree():
    model = pii.SkipChain({"bias": [0.3, 0.1, -0.2, 0.0, 0.4]}, np.random.default_rng(0).normal(size=(5, 5)).tolist(), np.zeros((5, 5)).tolist())
    text = "1 22 333"
    got = model.marginals(text, pii.candidates(text), {}, rounds=60)
    w = np.zeros((5, 5, 5))
    b = np.array([0.3, 0.1, -0.2, 0.0, 0.4])
    for i, j, k in itertools.product(range(5), repeat=3):
        w[i, j, k] = b[i] + b[j] + b[k] + model.chain[i, j] + model.chain[j, k]
    w = np.exp(w)
    w /= w.sum()
    assert np.allclose(got, [w.sum((1, 2)), w.sum((0, 2)), w.sum((0, 1))], atol=1e-6)


def test_messages_come_near_enumeration_on_a_loopy_graph():
    rnd = np.random.default_rng(3)
    node = {f"digits={d}": rnd.normal(size=5).tolist() for d in (4, 8)} | {"bias": rnd.normal(size=5).tolist()}
    skip = rnd.normal(size=(5, 5)) / 3 + np.eye(5)
    model = pii.SkipChain(node, (rnd.normal(size=(5, 5)) / 2).tolist(), ((skip + skip.T) / 2).tolist())
    text = "123456 ab4567 123-456 ab4567\n12-3456"
    spans = pii.candidates(text)
    chain, tied = pii.edges(text, spans)
    assert chain == [(0, 1), (1, 2), (2, 3)] and tied == [(0, 2), (1, 3), (2, 4), (0, 4)] or sorted(tied) == [(0, 2), (0, 4), (1, 3), (2, 4)]
    for observed in ({}, {0: 2}):
        local = model.local([text[a:b] for a, b in spans], observed)
        w = np.zeros((5,) * 5)
        for y in itertools.product(range(5), repeat=5):
            w[y] = sum(local[i, k] for i, k in enumerate(y)) + sum(model.chain[y[i], y[j]] for i, j in chain) + sum(model.skip[y[i], y[j]] for i, j in tied)
        w = np.exp(w - w.max())
        w /= w.sum()
        exact = np.stack([w.sum(tuple(j for j in range(5) if j != i)) for i in range(5)])
        got = model.marginals(text, spans, observed, rounds=300)
        assert np.abs(got - exact).max() < 0.08 and (got.argmax(1) == exact.argmax(1)).all()


def test_trained_field_carries_labels_to_alike_tokens():
    rnd = random.Random(5)
    number = lambda: f"{rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}"
    texts = []
    for _ in range(300):  # a number is a phone's each time it stands in a text, or never
        a, b = number(), number()
        texts.append(f"call +1 (555) {a} now\nroom {b} and room {b} are free\nagain +1 (555) {a} please")
    model = pii.train(texts)
    assert model.skip.shape == (5, 5) and np.allclose(model.skip, model.skip.T) and (np.diag(model.skip)[[0, 4]] > 0).all()
    a, b = "321-7654", "456-1234"
    text = f"call +1 (555) {a} now\nlater {a}\nand\n{b}"
    spans = pii.candidates(text)
    p = model.marginals(text, spans, pii.token_labels(spans, pii.base_spans(text)))
    again, other = (spans.index((text.rindex(x), text.rindex(x) + 8)) for x in (a, b))
    assert p[again, 4] > p[other, 4] + 0.1
    base, found = pii.find(text, model, certain=float(p[again, 4]) - 1e-6)
    added = set(found) - set(base)
    assert (text.rindex(a), text.rindex(a) + 8, 3) in added and set(base) <= set(found)
    assert pii.train([]).node == {} and pii.find("room 12", pii.train([]))[1] == []


def test_labels_of_tokens_by_one_sweep():
    rnd = random.Random(6)
    for _ in range(500):
        cuts = sorted(rnd.sample(range(60), 12))
        spans = [(cuts[i], cuts[i + 1]) for i in range(0, 12, 2)]
        base = sorted({(a, a + rnd.randrange(1, 20), rnd.randrange(4)) for a in rnd.sample(range(60), 5)}, key=lambda s: (s[0], s[2]))
        want = {}
        for a, b, k in base:
            for i, (c, d) in enumerate(spans):
                if c < b and a < d:
                    want.setdefault(i, k + 1)
        assert pii.token_labels(spans, base) == want


def test_fit_takes_few_texts_and_no_order_of_rows(spark):
    rows = [(i % 40, f"mail u{i % 40}@mail.example.com now") for i in range(80)] + [(None, "ip 10.0.0.1"), (50, None), (51, "no data"), (52, "9" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.fit(df).to_json() == pii.fit(df.orderBy(F.desc("doc_id")).repartition(7)).to_json()
    assert pii.fit(df.limit(0)).node == {}


def test_alike_neighbours_without_a_chain_edge_are_tied():
    model = pii.SkipChain({}, np.zeros((5, 5)).tolist(), (4 * np.eye(5)).tolist())
    for gap in ("\n", "\t", "  "):
        text = f"555-0101{gap}555-0101"
        spans = pii.candidates(text)
        assert len(spans) == 2 and model.marginals(text, spans, {0: 2})[1, 2] > 0.9
    assert np.allclose(model.marginals("555-0101 555-0101", pii.candidates("555-0101 555-0101"), {0: 2})[1], 0.2)


# 5


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, texts):
    rnd = random.Random(6)
    chain = [f"w{k}" for k in range(90)]
    drift = []
    for k in range(12):  # each links with the next, not with all
        chain = list(chain)
        chain[rnd.randrange(90)] = f"n{k}"
        drift.append(" ".join(chain))
    data = rows(texts + drift)
    df = spark.createDataFrame(data, DOCS).withColumnRenamed("lang", "component_id")
    want = brute_components([(r[0], r[1]) for r in data if r[0] is not None])
    got = jaccard.near_duplicates(df).collect()
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    stay = [r["doc_id"] for r in jaccard.keep_one(df).collect()]
    assert sorted(x for x in stay if x is not None) == sorted(i for i, (_, c) in want.items() if c == i) and None in stay
    assert jaccard.near_duplicates(df.limit(0)).collect() == []


def test_signatures_lose_no_pair():
    rnd = np.random.default_rng(8)
    bands, checked = jaccard.Bands(), 0
    for k in range(700):
        n = int(rnd.integers(1, 400)) if k < 600 else int(rnd.integers(700, 3000))
        a = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        keep = a[rnd.permutation(n)[: max(1, int(n * rnd.uniform(0.8, 1)))]]
        b = np.unique(np.concatenate((keep, rnd.integers(0, 1 << 63, int(rnd.integers(0, n // 6 + 1)), dtype=np.uint64))))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert np.intersect1d(jaccard.signatures(a, bands), jaccard.signatures(b, bands)).size
            differ = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(jaccard.sketch(a), jaccard.sketch(b), strict=True))
            assert differ <= len(a) + len(b) - 2 * both
            wide = [jaccard.wide_sketch(s) for s in (a, b)]
            if all(wide):
                checked += 1
                assert jaccard.wide_differ(*wide) == jaccard.wide_differ(*wide[::-1]) <= len(a) + len(b) - 2 * both
    assert checked > 20


# 6 and 9


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(DATA), special_tokens={})


def noise(rnd, n):
    alphabet = " \n\t\r\xa0  aab'sreélldtv019,.!?<>日本😀²ªʼ 　\x1c\x85ABC"
    return "".join(rnd.choice(alphabet) for _ in range(n))


def test_transducer_equals_the_library(reference):
    enc, rnd = Encoder(load_ranks(DATA), P.PATTERN, max_memory=50), random.Random(1)
    enc.transducer.max_states = 500
    ranks = list(load_ranks(DATA))
    for i in range(3000):
        t = noise(rnd, rnd.randrange(0, 30)) if i % 2 else "".join(rnd.choice(ranks).decode("utf8", "ignore") for _ in range(6))
        assert enc.encode(t) == reference.encode_ordinary(t), t


def test_stream_decoding():
    bytes_of = {i: b for b, i in load_ranks(DATA).items()}
    rnd = random.Random(2)
    for _ in range(300):
        data = "".join(rnd.choice("aé日😀") for _ in range(9)).encode() + bytes(rnd.randrange(256) for _ in range(rnd.randrange(4)))
        stream = Utf8Stream()
        cut = sorted(rnd.randrange(len(data) + 1) for _ in range(4))
        parts = [data[a:b] for a, b in zip([0, *cut], [*cut, len(data)], strict=True)]
        assert "".join(map(stream.feed, parts)) + stream.flush() == data.decode("utf8", "replace")
    single = load_ranks(DATA)
    ids = [single[bytes([b])] for b in "日本😀".encode()]
    assert "".join(t for _, t in decode_stream(bytes_of, ids, block=1)) == "日本😀"


def test_round_trip(spark, texts, reference):
    df = frame(spark, [*texts, noise(random.Random(5), 4000)]).withColumnRenamed("lang", "ids")
    for r in tokenize.round_trip(df.filter("doc_id is not null"), RANKS, P.PATTERN, keep_ids=True).collect():
        t = dict((x[0], x[1]) for x in rows([*texts, noise(random.Random(5), 4000)]))[r["doc_id"]] or ""
        ids = reference.encode_ordinary(t)
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = tokenize.decode_documents(tokenize.encode_documents(df, RANKS, P.PATTERN), RANKS)
    assert sorted(r["text"] for r in back.collect()) == sorted((x[1] or "") for x in rows([*texts, noise(random.Random(5), 4000)]))
    assert tokenize.round_trip(df.limit(0), RANKS, P.PATTERN).collect() == []


def test_edited_counts_equal_counting_anew(reference):
    enc, rnd = Encoder(load_ranks(DATA), P.PATTERN), random.Random(11)
    for i in range(250):
        text = prose(rnd, 200) if i % 2 else noise(rnd, 300)
        tree = token_counts.TokenTree(text, enc, leaf=4)
        for _ in range(8):
            pos, n = rnd.randrange(0, len(text) + 5), rnd.randrange(0, 12)
            new = rnd.choice(["", " ", "x", " new words here", noise(rnd, 6), "\n"])
            tree.edit(pos, n, new)
            p = min(pos, len(text))
            text = text[:p] + new + text[p + n :]
            assert tree.text == text and tree.n_tokens == len(reference.encode_ordinary(text)), (i, pos, n, new)


def test_edits_reencode_little(spark, reference):
    text = prose(random.Random(3), 5000)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.count_with_edits(df, token_counts.sample_edits(F.col("text")), RANKS, P.PATTERN, keep_text=True).collect()}
    assert got[1]["n_tokens"] == len(reference.encode_ordinary(text)) and got[1]["n_reencoded"] < got[1]["n_tokens"] / 10
    for r in got.values():
        assert r["n_tokens_edited"] == len(reference.encode_ordinary(r["text_edited"]))
    none = token_counts.count_with_edits(df, F.lit(None).cast(token_counts.EDITS), RANKS, P.PATTERN).collect()
    assert all(r["n_edits"] == 0 and r["n_tokens"] == r["n_tokens_edited"] for r in none)


def test_kept_trees_are_edited_where_edits_name_them(spark, reference, tmp_path):
    rnd = random.Random(15)
    texts = {i: prose(rnd, 150 * i) if i % 2 else noise(rnd, 200) for i in range(8)} | {8: None, 9: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("leaves", F.lit("clash"))
    token_counts.token_trees(df, RANKS, P.PATTERN).write.parquet(f"{tmp_path}/v0")
    now = {d: t or "" for d, t in texts.items()}
    for version in range(3):
        trees = spark.read.parquet(f"{tmp_path}/v{version}")
        assert {r["doc_id"]: r["n_tokens"] for r in trees.collect()} == {d: len(reference.encode_ordinary(t)) for d, t in now.items()}
        assert all("".join(x["text"] for x in r["leaves"]) == now[r["doc_id"]] for r in trees.collect())
        rows = []
        for d in (0, 1, 3, 9):
            for turn in range(2):
                pos, n, new = rnd.randrange(0, len(now[d]) + 1), rnd.randrange(0, 9), rnd.choice(["", " new", "x\n"])
                rows.append((d, 1 - turn, [(pos, n, new)]))
        for d, _, ((pos, n, new),) in sorted(rows, key=lambda r: r[:2]):
            now[d] = now[d][:pos] + new + now[d][pos + n :]
        edits = spark.createDataFrame([*rows, (77, 0, None)], f"doc_id long, turn int, edits {token_counts.EDITS}")
        out = token_counts.edit_trees(trees, edits, RANKS, P.PATTERN)
        out.write.parquet(f"{tmp_path}/v{version + 1}")
        got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/v{version + 1}").collect()}
        assert {d: r["version"] for d, r in got.items()} == {d: (version + 1 if d in (0, 1, 3, 9) else 0) for d in texts}
        assert got[5]["n_reencoded"] == 0 and got[3]["n_reencoded"] < got[3]["n_tokens"]
    assert token_counts.edit_trees(trees.limit(0), edits, RANKS, P.PATTERN).collect() == []
    both = df.unionByName(df.filter("doc_id = 1"))
    twice = token_counts.count_with_edits(both, token_counts.sample_edits(F.col("text")), RANKS, P.PATTERN).collect()
    assert len(twice) == 11 and token_counts.count_with_edits(df.limit(0), token_counts.sample_edits(F.col("text")), RANKS, P.PATTERN).collect() == []


# 7


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1000, "b": 1}])
def test_schedule_stays_within_one_block(weights):
    share = mixing.shares(weights, 97)
    slots = mixing.pfair(share)
    assert Counter(slots) == share and sum(share.values()) == 97
    done = Counter()
    for t, s in enumerate(slots * 3, 1):
        done[s] += 1
        assert all(abs(done[x] * 97 - t * c) < 97 for x, c in share.items())


def test_mixture_keeps_all_and_follows_targets(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), i % 2) for i in range(3000)] + [(1, "a", 0), (None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, source string, mix_slot int")
    got = mixing.mix_sources(df, {"a": 2.0, "b": 1.0, "c": 1.0}, block_docs=8, period=60, bucket_docs=40).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(x[0] for x in data)
    by = defaultdict(list)
    for r in got:
        by[r["mix_source"]].append(r)
    for s, rs in by.items():
        assert sorted(r["mix_block"] * 8 + r["mix_pos"] for r in rs) == list(range(len(rs)))
        order = sorted(rs, key=lambda r: (r["mix_slot"], r["mix_pos"]))
        keys = [hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest() for r in order]
        assert keys == sorted(keys)
    slots = {}
    for r in got:
        assert slots.setdefault(r["mix_slot"], (r["mix_source"], r["mix_block"])) == (r["mix_source"], r["mix_block"])
    assert mixing.mix_sources(df.limit(0)).collect() == []


# 8


def good_turing(counts):
    """Ratios for 1 to 5, worked out from the definition alone."""
    n = Counter(counts)

    def ratio(r, n):
        a = 6 * n[6] / n[1]
        return ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)

    try:
        d = [ratio(r, n) for r in range(1, 6)]
    except ZeroDivisionError:
        d = [-1]
    if not all(0 < x < 1 for x in d):
        pts = [(math.log(r), math.log(n[r])) for r in range(1, 7) if n[r]]
        slope = -2.0
        if len(pts) > 1:
            mx, my = (sum(p[i] for p in pts) / len(pts) for i in (0, 1))
            slope = min(-1.1, sum((x - mx) * (y - my) for x, y in pts) / sum((x - mx) ** 2 for x, y in pts))
        d = [ratio(r, {k: k**slope for k in range(1, 7)}) for r in range(1, 6)]
    return lambda c: c if c > 5 else d[c - 1] * c


class BruteKatz:
    """Katz backoff over whole histories as tuples."""

    def __init__(self, texts, order):
        self.order = order
        self.grams = [Counter() for _ in range(order + 1)]
        for w in texts:
            for m in range(1, order + 1):
                self.grams[m].update(self.gram(w, i, m) for i in range(max(m - 2, 0), len(w)))
        self.d = [None, *[good_turing(c.values()) for c in self.grams[1:]]]
        self.n, self.v = sum(self.grams[1].values()), len(self.grams[1])
        self.full = not any(c <= 5 for c in self.grams[1].values())
        self.left = (1 if self.full else self.n - sum(map(self.d[1], self.grams[1].values()))) / (self.n + self.full)
        self.after = [None, None, *[defaultdict(list) for _ in range(2, order + 1)]]
        for m in range(2, order + 1):
            for g, c in self.grams[m].items():
                self.after[m][g[:-1]].append((g[-1], c))

    @staticmethod
    def gram(w, i, m):
        """The m words up to i, of which the beginning may be one."""
        return ("<>", *w[: i + 1]) if i + 1 < m else tuple(w[i + 1 - m : i + 1])

    def p(self, history, w):
        if not history:
            c = self.grams[1][(w,)]
            return self.d[1](c) / (self.n + self.full) if c else self.left / self.v
        m = len(history) + 1
        seen = self.after[m][history]
        lower = lambda x: self.p(history[1:], x)
        if not seen:
            return lower(w)
        total = sum(c for _, c in seen)
        full = all(c > 5 for _, c in seen)
        for x, c in seen:
            if x == w:
                return self.d[m](c) / (total + full)
        left = (1 if full else total - sum(self.d[m](c) for _, c in seen)) / (total + full)
        return left / (1 - sum(lower(x) for x, _ in seen)) * lower(w)

    def score(self, w):
        out = 0.0
        for i, x in enumerate(w):
            out += math.log10(self.p(("<>", *w[:i])[-(self.order - 1) :] if self.order > 1 else (), x))
        return out


def katz_case(seed):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.paretovariate(1.1))}" for _ in range(200)]
    data = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 60)))) for i in range(150)]
    data += [(200 + i, "always never") for i in range(60)]  # a history all of whose counts are high
    kept_out = [i for i in range(400, 500) if zlib.crc32(str(i).encode()) % 5 == 1]
    data += [(kept_out[0], "always else"), (kept_out[1], "always"), (1000, None), (1001, "New WORDS")]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in data}
    return data, {d: [*WORD.findall(lower(t)), "</>"] for d, t in data}, held


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("kwargs", [{}, {"chunk_bytes": 500, "part_tokens": 300, "split": 20}])
def test_katz_equals_brute_force(spark, order, kwargs):
    data, toks, held = katz_case(12)
    brute = BruteKatz([w for d, w in toks.items() if not held[d]], order)
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("chunk", F.lit("x"))
    got = katz.score_documents(df, order=order, **kwargs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(toks)
    for r in got:
        w = toks[r["doc_id"]]
        base = sum(math.log10((brute.grams[1][(x,)] + 0.5) / (brute.n + 0.5 * (brute.v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum((x,) in brute.grams[1] for x in w), brute.n)
        assert abs(r["base_score"] - base) < 1e-8 and abs(r["score"] - brute.score(w)) < 1e-8


def test_katz_histories_sum_to_one():
    data, toks, held = katz_case(13)
    brute = BruteKatz([w for d, w in toks.items() if not held[d]], 2)
    assert not any(c <= 5 for _, c in brute.after[2][("always",)])
    for h in [("always",), *list(brute.after[2])[:20]]:
        seen = {w for w, _ in brute.after[2][h]}
        unseen = (1 - sum(brute.p((), w) for w in seen)) / brute.p((), "unheard of") * brute.p(h, "unheard of")
        assert abs(sum(brute.p(h, w) for w in seen) + unseen - 1) < 1e-9


def test_katz_edges(spark):
    assert katz.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = katz.score_documents(spark.createDataFrame([(None, "a b"), (7, "x " * 50_000), (7, "x " * 50_000)], "doc_id long, text string")).collect()
    assert sorted(r["n_tokens"] for r in rows) == [3, 50_001, 50_001] and len({r["score"] for r in rows if r["doc_id"] == 7}) == 1
    only_held = next(str(i) for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = katz.score_documents(spark.createDataFrame([(int(only_held), "a b")], "doc_id long, text string")).collect()
    assert (r["held_out"], r["train_tokens"], r["score"]) == (True, 0, 0.0)


@pytest.mark.parametrize("values", [[1] * 9, [9] * 4, [], [1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 5, 6], [1] * 100 + [2] * 30 + [3] * 12 + [4] * 7 + [5] * 4 + [6] * 2])
def test_discounts_lie_between_nought_and_one(values):
    n = Counter(values)
    d = katz.discounts([0, *[n[r] for r in range(1, 7)]])
    want = good_turing(values)
    assert all(0 < d[r] < 1 and abs(d[r] * r - want(r)) < 1e-9 for r in range(1, 6))


def test_squeezed_numbers_come_back():
    for x in ([], [0], [255, 1], [70_000, 3, 9], [1 << 40, 5]):
        assert katz.spread(katz.squeeze(np.array(x, np.int64))).tolist() == x


# 10


def test_chats_read_back_exactly(spark):
    rnd = random.Random(13)
    bits = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[NEXT]", "[ROLE]", "[TEXT]", "[/ROLE]", " ", "a", "\n", "[\\INST]", "é😀", ""]
    turns = [(c, t, rnd.choice(["user", "assistant", "system", "tool[ROLE]", None]), rnd.choice([None, "".join(rnd.choice(bits) for _ in range(rnd.randrange(6)))])) for c in range(80) for t in range(rnd.randrange(1, 9))]
    turns += [turns[0], (None, 1, "user", "x"), (7, None, "assistant", "first")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digest_chats(df).collect()}
    formatted = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x[3] for x in ts if x[2] == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in ts).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == len(formatted[c]["formatted"]) and len(formatted[c]["loss_spans"]) == sum(x[2] == "assistant" for x in ts)
    assert chat.digest_chats(df.limit(0)).collect() == []


def test_long_chats_keep_their_spans(spark):
    rnd = random.Random(16)
    turns = [(1, t, rnd.choice(["user", "assistant"]), "x" * rnd.randrange(0, 5) + f"<s>{t}") for t in range(3 * chat.BLOCK_TURNS + 5)]
    turns += [(2, t, "assistant", str(t)) for t in range(chat.BLOCK_TURNS)] + [(3, 0, "user", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for r in chat.format_chats(df).collect():
        spoken = [x[3] for x in turns if x[0] == r["conv_id"] and x[2] == "assistant"]
        assert [r["formatted"][s["start"] : s["end"]].replace("<\\s>", "<s>") for s in r["loss_spans"]] == spoken


def test_a_task_encodes_each_of_300000_stretches_once(monkeypatch):
    from cairn.llm import bpe

    cuts = []
    monkeypatch.setattr(bpe.Encoder, "_cut", lambda self, text: cuts.append(text) or (1,))
    words = [f" x{i}y" for i in range(300_000)]
    with bpe.encoding(open(RANKS, "rb").read(), P.PATTERN) as enc:
        assert enc.count(words) == enc.count(words) == len(words)
    assert len(cuts) == len(words)

"""The pipeline's stages, each against brute force over its own input, and the whole."""

import random

import corpus_pipeline as cp
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers as P
from cairn.llm import mixing
from cairn.llm.bpe import load_ranks
from test_llm import DATA, DOCS, WORD, brute_components, brute_longest, brute_stats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rnd = random.Random(31)
    text = lambda n: " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))
    shared = text(60)
    out = []
    for i in range(60):
        body = f"{text(70)}\n{text(40)}"
        if i % 10 == 3:
            body += f"\n{shared}\n{text(20)}"
        out.append((i, body, "en", "abc"[min(i % 6, 2)], len(body)))
    for k in range(5):  # near copies of the first, one word changed
        words = out[0][1].replace("\n", " \n ").split(" ")
        words[7 * k] = "changed"
        out.append((100 + k, " ".join(words), "en", "a", 1))
    out += [(200, out[1][1], "en", "b", 1), (201, "too short", "en", "a", 9), (202, None, None, None, None), (203, "", "en", None, 0), (204, "x " * 200, "en", "c", 400)]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), DOCS).withColumn("mix_slot", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = f"{sf}/out/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def held(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: (r[0] is None, r[0]))


def test_stages_return_documents(stages):
    assert all(sorted(x.columns) == sorted(COLUMNS) for x in stages[:-1])


def test_quality_stage_drops_what_base_rules_reject(stages):
    want = set()
    for d, t, *_ in corpus():
        n, *_, repeats = brute_stats(t)
        if n >= 50 and 100 * repeats <= 50 * n:
            want.add(d)
    assert {r[0] for r in held(stages[0])} == want  # all labels are good, so nothing more is learned


def test_line_stage_deletes_later_runs(stages):
    before = held(stages[0])
    gone = brute_longest([r[1] for r in before], 10)
    want = {}
    for r, lines in zip(before, gone, strict=True):
        left = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in lines)
        if not lines or WORD.search(left):
            want[r[0]] = left
    assert any(gone) and {r[0]: r[1] for r in held(stages[1])} == want
    assert all(r[4] == len(r[1]) for r in held(stages[1]))


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before = held(stages[1])
    found = brute_components([(r[0], r[1]) for r in before])
    assert held(stages[2]) == [r for r in before if found[r[0]][1] == r[0]] and len(held(stages[2])) < len(before)


def test_mixture_keeps_all_and_its_order_reaches_the_end(spark, stages):
    assert held(stages[3]) == held(stages[2])
    source = {r[0]: r[3] for r in held(stages[3])}
    placed = sorted((r["mix_slot"], r["mix_pos"], r["doc_id"]) for r in stages[4].collect())
    assert len({p[:2] for p in placed}) == len(placed)
    counts = {s: sum(x == s for x in source.values()) for s in set(source.values())}
    share = mixing.shares({s: n**0.5 for s, n in counts.items()}, 1024)
    slots = mixing.pfair(share)
    assert all(slots[slot % len(slots)] == source[d] for slot, _, d in placed)
    for t in range(1, len(slots) + 1, 37):  # every prefix of slots keeps to the weights, to within one block
        assert all(abs(slots[:t].count(s) * len(slots) - t * c) < len(slots) for s, c in share.items())


def test_tokens_are_the_librarys(stages):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(DATA), special_tokens={})
    texts = {r[0]: r[1] for r in held(stages[3])}
    got = {r["doc_id"]: list(r["ids"]) for r in stages[4].collect()}
    assert got == {d: reference.encode_ordinary(t) for d, t in texts.items()}


def test_run_is_the_stages_in_turn(spark, sf, stages):
    key = lambda r: r["doc_id"]
    assert sorted(cp.run(spark, sf).collect(), key=key) == sorted(stages[-1].collect(), key=key)


def test_run_on_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []

import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from cairn.functions import expr
from cairn.operators import dense, fixpoint, fusion, graph, lexical, lint, policy, resolution, state, summaries
from cairn.plans.answer import StubModel, answer, retrieve
from cairn.sources import bundle
from cairn.streaming import verdicts

HITS = "concept_id string, rank int"


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_fusion_goldens(spark):
    f = lambda rows: spark.createDataFrame(rows, HITS)
    got = fusion.fuse(f([("A", 1), ("B", 2)]), f([("A", 1)])).orderBy("rank").collect()
    assert [r["concept_id"] for r in got] == ["A", "B"]
    got = fusion.fuse(f([("o1", 1), ("o2", 2), ("cid", 3)]), f([])).orderBy("rank").collect()
    assert got[2]["concept_id"] == "cid" and abs(got[2]["score"] - 1 / 63) < 1e-9
    got = fusion.fuse(f([("b", 1)]), f([("a", 1)])).orderBy("rank").collect()
    assert [r["concept_id"] for r in got] == ["a", "b"]
    got = fusion.fuse(f([("insights/x", 1), ("sources/y", 1)])).orderBy("rank").collect()
    assert [r["concept_id"] for r in got] == ["sources/y", "insights/x"]
    repeat = fusion.fuse(f([("a", 1), ("a", 2), ("b", 3)])).collect()
    assert {r["concept_id"]: round(r["score"], 9) for r in repeat} == {"a": round(1 / 61, 9), "b": round(1 / 63, 9)}


def test_fusion_ignores_channel_order(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], HITS), spark.createDataFrame([("y", 1), ("z", 2)], HITS)
    assert fusion.fuse(a, b).collect() == fusion.fuse(b, a).collect()


def test_lexical_blank_and_hostile(spark):
    docs = spark.createDataFrame([("b", "of the sea"), ("a", "of the sea"), ("c", "the of")], "concept_id string, text string")
    assert lexical.search(docs, ["text"], lexical.quote("  "), 5).collect() == []
    assert lexical.search(docs, ["text"], lexical.quote('"*( ) ^'), 5).collect() == []
    assert [r["concept_id"] for r in lexical.search(docs, ["text"], lexical.quote('"of-the"'), 5).orderBy("rank").collect()] == ["a", "b"]
    assert ids(lexical.phrase_hits(lexical.index(docs, "text"), ["of", "the"]), "concept_id") == ["a", "b"]


def test_combine_is_a_semilattice(spark):
    names = [None, "", " public ", "private", "confidential", "odd"]
    rows = spark.createDataFrame([(a, b, c) for a in names for b in names for c in names], "a string, b string, c string")
    ab, ba = expr.combine(F.col("a"), F.col("b")), expr.combine(F.col("b"), F.col("a"))
    left, right = expr.combine(ab, F.col("c")), expr.combine(F.col("a"), expr.combine(F.col("b"), F.col("c")))
    assert rows.filter((ab != ba) | (left != right) | (expr.combine(ab, ab) != ab)).count() == 0
    assert rows.filter(expr.blocks_send(F.col("a"))).select("a").distinct().count() == 4
    with pytest.raises(ValueError):
        expr.raise_by(F.lit("public"), -1)


def brute_closure(edges, roots):
    parents = {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
    out = set(roots)
    while add := {c for c, ps in parents.items() if ps <= out} - out:
        out |= add
    return sorted(out)


def test_closures_equal_brute_force(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)]
    df = spark.createDataFrame(edges, "child long, parent long")
    roots = spark.createDataFrame([(i,) for i in range(0, 60, 4)], "id long")
    start = list(range(0, 60, 4))
    assert ids(fixpoint.closure(df, roots)) == brute_closure(edges, start)
    seen = set(start)
    while add := {c for c, p in edges if p in seen} - seen:
        seen |= add
    assert ids(fixpoint.reachable(df, roots)) == sorted(seen)
    again = fixpoint.closure(df, fixpoint.closure(df, roots))
    assert ids(again) == brute_closure(edges, start)


def test_high_water_needs_known_parents(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "gone"), ("d", "a"), ("s", "a")], "child string, parent string")
    levels = spark.createDataFrame([("a", 2, False), ("b", 0, False), ("c", 1, False), ("d", 0, False), ("s", 0, True)], "id string, level int, is_source boolean")
    assert {r["id"]: r["level"] for r in fixpoint.high_water(edges, levels).collect()} == {"a": 2, "b": 2, "c": 2, "d": 0, "s": 0}


def test_near_and_acronym_pairs_equal_all_pairs(spark):
    from cairn.functions import kernels

    rnd = random.Random(8)
    words = ["stoic", "stoicism", "cats", "carts", "run", "ruin", "abc", "axbxc", "model", "context", "protocol", "mcp", "server", "of", "ai", "agent", "agents"]
    docs = [(f"d{i:03d}", rnd.choice("PQ"), None, " ".join(rnd.choices(words, k=rnd.randrange(1, 4)))) for i in range(90)]
    df = resolution.eligible(spark.createDataFrame(docs, "concept_id string, type string, type_alternative string, title string"), spark.createDataFrame([], "concept_id string"))
    got = {(r["id_a"], r["id_b"]): r["score"] for r in resolution.near_pairs(df).collect()}
    want, acronyms = {}, {}
    for a, b in itertools.combinations(docs, 2):
        if a[1] == b[1] and a[3] != b[3]:
            if (s := kernels.near_match(a[3], b[3])) is not None:
                want[a[0], b[0]] = round(s, 6)
            if m := kernels.acronym_match(a[3], b[3]):
                acronyms[a[0], b[0]] = m
    assert got == want
    assert {(r["id_a"], r["id_b"]): r["acronym"] for r in resolution.acronym_pairs(df).collect()} == acronyms
    assert len(resolution.report(df, 7).collect()) == 7


def test_proximity_bound_is_inclusive(spark):
    import math

    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [math.cos(0.5), math.sin(0.5)]), ("c", None)], "concept_id string, embedding array<double>")
    at = math.cos(0.5)
    assert len(dense.proximity_pairs(v, at - 1e-9).collect()) == 1 and dense.proximity_pairs(v, at + 1e-6).collect() == []
    assert [r["neighbour_id"] for r in dense.neighbours(v, 2).filter("concept_id = 'a'").orderBy("rank").collect()] == ["a", "b"]
    filed = dense.near_duplicates([1.0, 0.0], v, 0.5).collect()
    assert [r["concept_id"] for r in filed] == [None]  # c has no vector: all or nothing


def test_neighbours_break_ties_of_many_copies_by_id(spark):
    import math

    rnd = random.Random(4)
    vecs = [[rnd.uniform(-1, 1) for _ in range(16)] for _ in range(400)]
    for i in rnd.sample(range(400), 40):
        vecs[i] = vecs[7]
    names = [f"v{i:04d}" for i in range(400)]
    v = spark.createDataFrame(list(zip(names, vecs, strict=True)), "concept_id string, embedding array<double>")
    want = {(a, n): b for a, x in zip(names, vecs, strict=True) for n, (_, b) in enumerate(sorted((round(math.dist(x, y), 9), b) for b, y in zip(names, vecs, strict=True))[:6], 1)}
    for block, wide in ((2048, 8), (100, 8), (30, 2)):
        assert {(r["concept_id"], r["rank"]): r["neighbour_id"] for r in dense.neighbours(v, 6, block, wide).collect()} == want
    alike = spark.createDataFrame([("x", [1.0, 0.0])] * 5, "concept_id string, embedding array<double>")
    assert [r["rank"] for r in dense.neighbours(alike, 9, 2, 1).filter("neighbour_id = 'x'").collect()] == [1, 2, 3, 4, 5] * 5
    copies = [n for n, x in zip(names, vecs, strict=True) if x == vecs[7]]
    pairs = {(r["id_a"], r["id_b"]) for r in dense.proximity_pairs(v, 0.999999).collect()}
    near = {c: [b for b in copies[:6] if b != c][:5] for c in copies}
    assert pairs == {tuple(sorted((c, b))) for c in copies for b in near[c]}


def test_state_rules(spark):
    f = spark.createDataFrame([(1, [("a", "x")]), (2, [("b", "x")]), (3, [("gone", "x")])], "id long, input_digests array<struct<ref: string, digest: string>>")
    now = spark.createDataFrame([("a", "x"), ("b", "y")], "ref string, digest string")
    assert {r["id"]: r["stale"] for r in state.stale(f, now).collect()} == {1: False, 2: True, 3: False}
    docs = spark.createDataFrame([("a", "1")], "concept_id string, body string")
    stored = spark.createDataFrame([("z", "h")], "concept_id string, content_hash string")
    assert {r["concept_id"]: r["action"] for r in state.classify(docs, stored, walk_errors=True).collect()} == {"a": "embed", "z": "keep"}
    assert state.gate(False, "a", "b") and not state.gate(False, "a", "a")


def test_budget_keeps_room_for_merged(spark):
    pair = lambda n, p: spark.createDataFrame([(f"{p}{i:04d}", "x") for i in range(n)], "id_a string, id_b string")
    kinds = lambda e, m: {r["kind"]: r["count"] for r in graph.budget(pair(e, "e"), pair(m, "m")).groupBy("kind").count().collect()}
    assert kinds(300, 80) == {"edge": 150, "merged": 50} and kinds(300, 10) == {"edge": 190, "merged": 10} and kinds(20, 300) == {"edge": 20, "merged": 180}


def test_bundle_rows_and_graph(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("index.md", "x")
    put("concepts/a.md", "---\ntype: Concept\ntitle: A\ntags: [x, y]\nprovenance: [sources/s.md]\nrelations:\n- {target: concepts/b, type: part_of}\nodd: 1\n---\nsee [s](/sources/s.md#t)\n```\n[b](/concepts/b.md)\n```\n")
    put("concepts/b.md", "---\ntype: Concept\ntitle: B\nrelations: [1]\ntags: one\n---\n")
    put("sources/s.md", "---\ntype: Source\ntitle: S\nsensitivity: ''\n---\nbody")
    put("bad/fence.md", "no fence")
    put("bad/yaml.md", "---\n: [\n---\n")
    put("bad/bytes.md", b"\xff\xfe")
    put(unicodedata.normalize("NFD", "concepts/é.md"), "---\ntype: Concept\n---\n")
    docs = bundle.read_bundle(spark, f"file://{tmp_path}").cache()
    rows = {r["concept_id"]: r for r in docs.collect()}
    assert set(rows) == {"concepts/a", "concepts/b", "sources/s", "bad/fence", "bad/yaml", "bad/bytes", "concepts/é"}
    assert rows["bad/bytes"]["read_error"] and rows["bad/fence"]["parse_error"] and rows["bad/yaml"]["parse_error"]
    assert rows["concepts/a"]["tags"] == ["x", "y"] and rows["concepts/b"]["tags"] is None and not rows["concepts/b"]["relations_valid"] and rows["concepts/a"]["extra"] == {"odd": "1"}
    from cairn.functions.text_udfs import mask_fences

    links = graph.body_links(docs.withColumn("body", mask_fences("body")))
    edges = graph.edges(docs.select("concept_id"), links, bundle.relations_of(docs), bundle.provenance_of(docs))
    assert sorted(map(tuple, edges.collect())) == [("concepts/a", "concepts/b", "part_of"), ("concepts/a", "sources/s", "derived_from")]
    assert lint.conformance(docs.withColumnRenamed("concept_id", "id").withColumn("path", F.col("id"))).count() == 4
    assert policy.sensitive(docs).count() == 7
    text = {r["concept_id"]: r["text"] for r in bundle.embed_text(docs).collect()}
    assert text["concepts/a"].startswith("A\n\nx y\n\nsee")
    again = bundle.parse("x.md", bundle.render({"type": "Concept", "title": "T", "tags": []}, "b").encode())
    assert (again["type"], again["title"], again["body"], again["tags"]) == ("Concept", "T", "b", None)


def test_answer_filters_after_the_cut(spark):
    concepts = spark.createDataFrame([(f"c{i}", "t", "alpha " * (12 - i), "deprecated" if i < 9 else "active", "private") for i in range(12)], "concept_id string, title string, body string, status string, sensitivity string")
    none = spark.createDataFrame([], "source_id string, target_id string, relation_type string")
    hits = retrieve(concepts, None, none, "alpha", None, limit=5, pool=10)
    assert hits.count() == 1  # ten were taken, nine of them excluded
    got = answer("alpha", hits, concepts, StubModel())
    assert got.status == "answered" and len(got.citations) == 1
    assert answer(" ", hits, concepts, StubModel()).status == "empty_query"
    assert answer("q", hits.limit(0), concepts, StubModel()).status == "zero_hits"


def test_verdicts_and_merges(spark):
    rows = spark.createDataFrame([("contradicts", 2.0, ["c"]), ("CONTRADICTS", float("nan"), None), ("odd", -1.0, ["c"])], "verdict string, confidence double, claims array<string>")
    assert [(r["verdict"], r["confidence"]) for r in summaries.verdicts(rows).collect()] == [("CONTRADICTS", 1.0), ("UNCERTAIN", 0.0), ("UNCERTAIN", 0.0)]
    odd = spark.createDataFrame([("contradicts", float("inf"), [" ", None, ""]), (" Consistent", float("-inf"), None)], "verdict string, confidence double, claims array<string>")
    assert [(r["verdict"], r["confidence"]) for r in summaries.verdicts(odd).collect()] == [("UNCERTAIN", 0.0), ("CONSISTENT", 0.0)]
    assert lint.window_for(spark.createDataFrame([("Person", None), ("Event", None), ("Odd", None), ("Event", "slow")], "type string, volatility string")).select("window_days").collect()[0][0] == 90


def test_streaming_equals_batch(spark, tmp_path):
    data = [(i, f"2024-01-0{i % 3 + 1} 00:00:0{i % 10}", i % 2, "k", float(i)) for i in range(20)]
    df = spark.createDataFrame(data, "event_id long, t string, user_id int, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = verdicts.read_events(spark, str(tmp_path / "in"), df.schema)
    got = verdicts.run_once(verdicts.latest(stream, ["user_id"]), "latest").select("user_id", "value").collect()
    assert sorted(got) == sorted(verdicts.latest(df, ["user_id"]).select("user_id", "value").collect())
    for _ in range(2):
        verdicts.sink_latest(spark, df, str(tmp_path / "store"), ["user_id"])
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    days = verdicts.run_once(verdicts.windowed(verdicts.read_events(spark, str(tmp_path / "in"), df.schema)), "days")
    assert days.agg(F.sum("n")).first()[0] == 20


def test_merged_relations_keep_the_survivors_own_loop(spark):
    kind = "array<struct<target: string, type: string>>"
    rows = spark.createDataFrame([([("s", "related_to"), ("a", "part_of"), ("x", "part_of")], [("s", "part_of"), ("a", "part_of"), ("x", "part_of"), ("b", "references")])], f"a {kind}, b {kind}")
    (got,) = rows.select(summaries.merged_relations(F.col("a"), F.col("b"), F.lit("s"), F.lit("a")).alias("m")).first()
    assert [tuple(r) for r in got] == [("b", "references"), ("s", "related_to"), ("x", "part_of")]


def test_transcripts_and_their_cost(spark):
    turns = "\n".join(f"[10:{i:02d}] {'Ana Ruiz' if i % 2 else 'B'}: well, point {i}" for i in range(10))
    bodies = {1: turns, 2: turns.replace("Ana Ruiz", "ANA"), 3: "\n".join(["prose here"] * 11) + "\n" + turns, 4: "one two three four: x\n" * 12, 5: None, 6: "", 7: "INFO: a\nINFO: b\n" * 9}
    df = spark.createDataFrame([(k, "Notes", v) for k, v in bodies.items()], "doc_id long, title string, body string")
    shape = {r["doc_id"]: r for r in summaries.transcript_shape(df).collect()}
    assert [k for k, r in shape.items() if r["is_transcript"]] == [1] and set(shape) == set(bodies)
    assert (shape[1]["speakers"], shape[1]["recurring"], shape[1]["lines"]) == (2, 10, 10) and (shape[5]["lines"], shape[6]["lines"]) == (0, 0)
    prose = "\n".join("x" * 99 for _ in range(181))
    long = spark.createDataFrame([("p", "Report", prose, False), ("m", "Weekly standup", prose[:12_001], True), ("n", "Report", prose[:12_001], False), ("w", "Report", "y" * 20_000, False)], "concept_id string, title string, body string, meeting boolean")
    cost = {r["concept_id"]: (r["windows"], r["calls"]) for r in summaries.extraction_cost(long).collect()}
    assert cost == {"p": (5, 6), "m": (4, 6), "n": (0, 3), "w": (1, 2)}
    from cairn.functions.kernels import chunk_lines

    assert (len(chunk_lines(prose)), len(chunk_lines(prose[:12_001]))) == (5, 4)
    assert {r["calls"] for r in summaries.extraction_cost(long, union_judge=False).collect()} == {5, 4, 1}
    named = {r["doc_id"]: r["meeting"] for r in summaries.meeting_shaped(df.withColumn("title", F.when(F.col("doc_id") == 4, "La Reunión de hoy").otherwise("x"))).collect()}
    assert [k for k, v in named.items() if v] == [1, 4] or sorted(k for k, v in named.items() if v) == [1, 4]


def test_report_bridges_types_and_names_them(spark):
    from cairn.functions import kernels as K

    rnd = random.Random(21)
    words = ["stoic", "stoicism", "garden", "gardens", "model", "context", "protocol", "mcp", "with", "app"]
    docs = [(f"d{i:02d}", rnd.choice("ABC"), rnd.choice([None, "A", "B", " C ", ""]), " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4)))) for i in range(45)]
    docs += [("x1", "A", "B", "model context protocol"), ("x2", "B", None, "mcp"), ("x3", "C", "A", "mcp app")]
    df = spark.createDataFrame(docs, "concept_id string, type string, type_alternative string, key string")
    want = {}
    for (a, ta, xa, ka), (b, tb, xb, kb) in itertools.combinations(docs, 2):
        bridged = (xa or "").strip() == tb or (xb or "").strip() == ta
        if ka != kb and (ta == tb or bridged):
            label = "+".join(sorted({ta, tb}))
            if found := K.acronym_match(ka, kb):
                want[a, b] = ("ACRONYM", found, label)
            elif (score := K.near_match(ka, kb)) is not None:
                want[a, b] = ("LOW", f"{score:.3f}", label)
    got = resolution.report(df, 10_000).collect()
    assert {tuple(r["member_ids"]): (r["tier"], r["trigger"], r["type"]) for r in got if r["tier"] != "HIGH"} == want
    assert any("+" in x[2] for x in want.values()) and any(x[0] == "ACRONYM" for x in want.values())
    groups = {}
    for d, t, _, k in docs:
        groups.setdefault(k, []).append((d, t))
    high = {k: (sorted(x for x, _ in m), "+".join(sorted({t for _, t in m}))) for k, m in groups.items() if len(m) > 1}
    assert {r["trigger"]: (r["member_ids"], r["type"]) for r in got if r["tier"] == "HIGH"} == high
    assert {r["produced"] for r in got} == {len(want) + len(high)}
    few = resolution.report(df, 5).collect()
    assert len(few) == 5 and {r["produced"] for r in few} == {len(got)}
    assert resolution.truncation_notice(len(got), 5) == f"5 of {len(got)} candidate group(s) shown (cap reached)" and resolution.truncation_notice(5, 5) is None


def test_closures_of_many_sources_equal_brute_force(spark):
    rnd = random.Random(4)
    edges = sorted({(rnd.randrange(1, 60), rnd.randrange(0, 60)) for _ in range(110)})
    df = spark.createDataFrame(edges, "child long, parent long")
    roots = [0, 7, 8]
    parents = {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
    want = set()
    for s in roots:
        held = {s}
        while new := {c for c, ps in parents.items() if ps <= held and c not in held}:
            held |= new
        want |= {(s, i) for i in held}
    got = fixpoint.closures(df, spark.createDataFrame([(s, s) for s in roots], "source long, id long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    chain = spark.createDataFrame([(i + 1, i) for i in range(20)], "child long, parent long")
    assert fixpoint.closure(chain, spark.createDataFrame([(0,)], "id long")).count() == 21
    assert fixpoint.reachable(chain, spark.createDataFrame([(3,)], "id long")).count() == 18


def test_lint_report_unites_all_checks(spark, tmp_path):
    docs = {
        "sources/a.md": "type: Source\ntitle: A\nresource: raw/a.md\nsensitivity: confidential\nextraction_status: failed\nextraction_notice: judge-selection-empty",
        "sources/b.md": "type: Source\ntitle: B\nsensitivity: private\nextraction_notice: objects-without-evidence",
        "concepts/one.md": "type: Concept\ntitle: One\nsensitivity: public\nprovenance: [sources/a.md]",
        "concepts/two.md": "type: Concept\ntitle: Two\nsensitivity: public\nprovenance: [sources/a, sources/b]",
        "concepts/three.md": "type: Concept\ntitle: Three\nprovenance: [sources/gone]\nrelations:\n- {target: concepts/none, type: derived_from}",
        "concepts/scalar.md": "type: Concept\ntitle: S\nprovenance: sources/a",
        "concepts/badrel.md": "type: Concept\ntitle: R\nrelations: nope",
        "projects/old.md": "type: Project\ntitle: Old",
    }
    for name, head in docs.items():
        path = tmp_path / "bundle" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"---\n{head}\n---\nSeen (as of 2026-01-01).\n")
    (tmp_path / "bundle" / "concepts" / "noyaml.md").write_text("plain")
    refs = spark.createDataFrame([(None, "concepts/one"), (None, "sources/a"), ("concepts/one", "concepts/two"), ("concepts/one", "sources/b"), ("concepts/two", "missing")], "source_id string, target_id string")
    got = [tuple(r) for r in lint.report(bundle.read_bundle(spark, str(tmp_path / "bundle")), refs, "2026-05-01").collect()]
    found = {(k, p) for k, p, _, _ in got}
    assert {p for k, p in found if k == "skipped"} == {"concepts/scalar.md", "concepts/badrel.md", "concepts/noyaml.md"}
    assert {p for k, p in found if k == "orphan"} == {"concepts/three", "projects/old"}
    assert {(p, d) for k, p, d, _ in got if k == "dangling-target"} == {("concepts/two", "missing"), ("concepts/three", "concepts/none")}
    assert {("unextracted", "sources/a"), ("unjudged", "sources/a"), ("unevidenced", "sources/b"), ("dangling-provenance", "concepts/three"), ("unbacked-relation", "concepts/three")} <= found
    assert {p for k, p in found if k == "below-source-sensitivity"} == {"concepts/one"}
    assert [(p, r) for k, p, _, r in got if r] == [("concepts/two", "set-sensitivity concepts/two confidential")]
    assert {p for k, p in found if k == "stale-stamp"} >= {"projects/old", "concepts/one"} and ("stale-stamp", "sources/a") not in found


def test_evidence_pairs_equal_all_pairs(spark):
    from cairn.functions import kernels as K

    rnd = random.Random(9)
    vocab = ["the", "of", "Fox", "fox.", "runs", "ΣΑΣ", "straße", "a,", "b", "c"]
    line = lambda n: rnd.choice(["", "- ", "# ", "1. "]) + " ".join(rnd.choice(vocab) for _ in range(n))
    shared = [line(rnd.randrange(3, 9)) for _ in range(12)]
    text = lambda: "\n".join(rnd.choice([rnd.choice(shared), line(rnd.randrange(1, 7)), "x" + rnd.choice(shared) + "y z"]) for _ in range(rnd.randrange(0, 6)))
    bodies, sources = [(i, text()) for i in range(25)] + [(99, None)], [(i, text().upper() if i % 5 == 0 else text()) for i in range(40)] + [(98, None)]
    got = lexical.evidence_pairs(spark.createDataFrame(bodies, "body_id long, body string"), spark.createDataFrame(sources, "source_id long, text string")).collect()
    want = {(i, j): e for i, b in bodies for j, t in sources if b is not None and t is not None and (e := K.evidence_line(b, t)) is not None}
    assert len(got) == len(want) and {(r[0], r[1]): r[2] for r in got} == want and len(want) > 20


def test_tokens_fold_as_the_index_of_the_reference_store(spark):
    import sqlite3

    texts = [f"q{c}z {c}" for c in map(chr, [*range(0xC0, 0x250), *range(0x300, 0x330)]) if c.isalpha() or unicodedata.combining(c)] + ["Élan vital; NAÏVE-façade x1 e\u0301t"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize = 'unicode61')")
    con.execute("create virtual table v using fts5vocab(t, instance)")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts)))
    want = {}
    for term, doc, _, place in con.execute("select term, doc, col, offset from v order by doc, offset"):
        want.setdefault(doc, []).append(term)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    got = {r["id"]: list(r["t"]) for r in df.select("id", lexical.tokens(F.col("x")).alias("t")).collect()}
    differ = [texts[i] for i in want if [w for w in got[i] if w] != want[i]]
    assert len(differ) <= 0.03 * len(texts), differ
    assert got[len(texts) - 1] == want[len(texts) - 1] == ["elan", "vital", "naive", "facade", "x1", "et"]
    assert lexical.quote("Élan NAÏVE-façade") == [["elan"], ["naive", "facade"]]


def test_vector_store_upserts_prunes_and_forgets(spark):
    store = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "concept_id string, content_hash string")
    changes = spark.createDataFrame([("b", "2"), ("d", "2"), ("d", "2")], "concept_id string, content_hash string")
    merged = dense.upsert(store, changes, ["concept_id"])
    assert sorted(map(tuple, merged.collect())) == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "2")]
    seen = spark.createDataFrame([("a",), ("a",), ("d",)], "concept_id string")
    assert sorted(r[0] for r in dense.prune(merged, seen, ["concept_id"]).collect()) == ["a", "d"]
    findings = merged.withColumnRenamed("concept_id", "survivor_id")
    assert sorted(r["survivor_id"] for r in state.forget(findings, seen, "survivor_id").collect()) == ["b", "c"]
    assert dense.upsert(store.limit(0), changes.limit(0), ["concept_id"]).collect() == []


def test_raw_files_and_built_documents(spark, tmp_path):
    for name, text in (("a.md", "one\ntwo"), ("b.TXT", ""), ("c.pdf", "no")):
        (tmp_path / name).write_text(text)
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in bundle.read_raw(spark, f"{tmp_path}/*").collect()}
    assert got.pop("b.TXT", "") == "" and got == {"a.md": "one\ntwo"}
    rows = [("Person", "Ana", "who", "b", "ana"), ("Source", "S", "d", "", "s"), ("Concept", " ", "d", "", "x"), ("Concept", "T", "", "", "t"), ("Concept", "T\nU", "d", "", "u"), (None, "T", "d", "", "n")]
    good, bad = bundle.build(spark.createDataFrame(rows, "type string, title string, description string, body string, slug string"))
    assert [r["concept_id"] for r in good.collect()] == ["people/ana"]
    assert {r["slug"]: r["reason"] for r in bad.collect()} == {"s": "type", "x": "title", "t": "description", "u": "newline", "n": "type"}


def test_names_that_are_not_composed_or_misplaced(spark):
    names = ["concepts/é.md", "concepts/é.md", ".state/ledger.md", "a/.state/b.md", "a/state/b.md", ".state/x.json"]
    got = {(r["kind"], r["path"]) for r in lint.names(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {("non-nfc-name", "concepts/é.md"), ("state-markdown", ".state/ledger.md"), ("state-markdown", "a/.state/b.md")}

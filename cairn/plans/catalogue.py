"""The registered queries over the driver's tables; their DuckDB equivalents are in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import expr, text_udfs
from cairn.operators import dense, fixpoint, fusion, graph, lexical, lint, policy, replies, resolution, state, summaries
from cairn.plans.answer import retrieve
from cairn.sources.adapters import relation, table

_REGISTRY: dict = {}


def query(f):
    _REGISTRY[f.__name__] = f
    return f


def queries() -> dict:
    return dict(_REGISTRY)


def oracle_sql() -> dict[str, str]:
    from cairn.plans.oracles import ORACLES

    return dict(ORACLES)


QUESTION = "the thonin of la shing"
QUERY_VECTOR = [round(((7 * i) % 13 - 6) / 20, 2) for i in range(64)]
TODAY = "2001-08-01"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_pool_filter_fuse(spark, sf_dir)


# Lexical and dense search, fusion


@query
def bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("concept_id"), "text")
    return _rounded(lexical.search(docs, ["text"], lexical.quote("inor heedthing erthes shea"), 20), "score")


@query
def phrase_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("concept_id"), "text")
    return _rounded(lexical.search(docs, ["text"], lexical.quote("of-the in-the and-the"), 20), "score")


@query
def postings_phrase(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("concept_id"), "text")
    return lexical.phrase_hits(lexical.index(docs, "text"), ["of", "the"])


@query
def index_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("concept_id"), "text")
    return lexical.statistics(lexical.index(docs, "text"))


@query
def fts_query_terms(spark, sf_dir):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(expr.query_terms(first), " ").alias("terms"))


@query
def knn_l2(spark, sf_dir):
    return _rounded(dense.nearest(relation(spark, sf_dir, "vectors"), QUERY_VECTOR, 20), "distance")


@query
def neighbors_topk(spark, sf_dir):
    return _rounded(dense.neighbours(relation(spark, sf_dir, "vectors"), 6), "distance")


@query
def proximity_pairs(spark, sf_dir):
    return _rounded(dense.proximity_pairs(relation(spark, sf_dir, "vectors"), 0.40), "distance")


@query
def near_duplicate_questions(spark, sf_dir):
    return _rounded(dense.near_duplicates(QUERY_VECTOR, relation(spark, sf_dir, "vectors"), 0.2), "similarity")


def _channels(spark, sf_dir):
    concepts = relation(spark, sf_dir, "concepts")
    fts = lexical.search(concepts, ["title", "body"], lexical.quote("inor heedthing erthes shea"), 30).select("concept_id", "rank")
    vec = dense.nearest(relation(spark, sf_dir, "vectors").select(F.concat(F.lit("documents/"), "vec_id").alias("concept_id"), "embedding"), QUERY_VECTOR, 30)
    return concepts, fts, vec.select("concept_id", "rank")


@query
def rrf_fuse(spark, sf_dir):
    _, fts, vec = _channels(spark, sf_dir)
    return _rounded(fusion.fuse(fts, vec), "score")


@query
def insight_penalty(spark, sf_dir):
    _, fts, vec = _channels(spark, sf_dir)
    turn = lambda d: d.withColumn("concept_id", F.when(F.regexp_extract("concept_id", r"(\d+)$", 1).cast("long") % 2 == 0, F.replace("concept_id", F.lit("documents/"), F.lit("insights/"))).otherwise(F.col("concept_id")))
    return _rounded(fusion.fuse(turn(fts), turn(vec)), "score")


@query
def retrieval_pool_filter_fuse(spark, sf_dir):
    vectors = relation(spark, sf_dir, "vectors").select(F.concat(F.lit("documents/"), "vec_id").alias("concept_id"), "embedding")
    relations = relation(spark, sf_dir, "relations").filter("relation_type = 'supersedes'")
    return _rounded(retrieve(relation(spark, sf_dir, "concepts"), vectors, relations, "inor heedthing erthes shea", QUERY_VECTOR, limit=10, pool=30), "score")


# Policy


@query
def deprecated_set(spark, sf_dir):
    return policy.deprecated(relation(spark, sf_dir, "concepts"), relation(spark, sf_dir, "relations"))


@query
def egress_blocked(spark, sf_dir):
    return policy.sensitive(relation(spark, sf_dir, "concepts"), "confidential")


@query
def combine_sensitivity(spark, sf_dir):
    own = relation(spark, sf_dir, "concepts").select("doc_id", "sensitivity")
    other = own.select((F.col("doc_id") + 1).alias("doc_id"), F.col("sensitivity").alias("other"))
    return policy.combined(own.join(other, "doc_id"), "sensitivity", "other").select("doc_id", "combined")


@query
def merged_content_blocked(spark, sf_dir):
    own = relation(spark, sf_dir, "concepts").select("doc_id", "sensitivity", F.lit("private").alias("b"), F.lit(" public ").alias("c"))
    return policy.merged_blocked(own, "sensitivity", "b", "c").select("doc_id", "blocked")


@query
def birth_sensitivity(spark, sf_dir):
    out = summaries.birth_level(relation(spark, sf_dir, "concepts").select("concept_id", "type"), {"Person": 1, "Decision": 0}, "public")
    return out.select("concept_id", "type", "sensitivity")


# Graph


def _edges(spark, sf_dir):
    rel = relation(spark, sf_dir, "relations").filter("relation_type <> 'supersedes'")
    return graph.edges(relation(spark, sf_dir, "nodes"), relation(spark, sf_dir, "links"), rel, relation(spark, sf_dir, "mirror"))


@query
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query
def edge_summary(spark, sf_dir):
    return graph.summary(_edges(spark, sf_dir), ["nation", "region", "customer", "orders", "part"])


def _blocked(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size > 45").select(F.concat(F.lit("part/"), "p_partkey").alias("concept_id"))


@query
def untyped_candidates(spark, sf_dir):
    return graph.untyped_candidates(_edges(spark, sf_dir), _blocked(spark, sf_dir))


@query
def candidate_edges(spark, sf_dir):
    pairs = dense.proximity_pairs(relation(spark, sf_dir, "vectors"), 0.40)
    linked = relation(spark, sf_dir, "vectors").filter("vec_id % 3 = 0").select("concept_id", (F.col("vec_id") + 1).alias("n"))
    linked = linked.select(F.col("concept_id").alias("source_id"), F.concat(F.lit("vec/"), "n").alias("target_id"))
    return _rounded(graph.candidate_edges(pairs, linked, 5, 50), "distance")


@query
def contradiction_pairs(spark, sf_dir):
    return graph.contradiction_pairs(_edges(spark, sf_dir), _blocked(spark, sf_dir))


@query
def contradiction_budget(spark, sf_dir):
    merged = table(spark, sf_dir, "part").filter("p_size = 7").select(F.concat(F.lit("part/"), "p_partkey").alias("id_a"), F.lit("merged").alias("id_b"))
    return graph.budget(graph.contradiction_pairs(_edges(spark, sf_dir), _blocked(spark, sf_dir)), merged)


@query
def pair_relation_types(spark, sf_dir):
    return graph.pair_labels(_edges(spark, sf_dir))


@query
def simple_digraph(spark, sf_dir):
    return graph.simple_digraph(_edges(spark, sf_dir))


@query
def graph_adjacency(spark, sf_dir):
    return graph.adjacency(_edges(spark, sf_dir), "part/7")


@query
def inbound_references(spark, sf_dir):
    broken = table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(F.concat(F.lit("part/"), "p_partkey").alias("concept_id"), F.concat(F.lit("see customer/"), F.col("p_size") % 5).alias("body"))
    rel = relation(spark, sf_dir, "relations")
    return graph.inbound("customer/3", relation(spark, sf_dir, "links"), rel, broken)


# Fixpoints


def _ids(spark, low, high):
    return spark.range(low, high + 1).select("id")


@query
def closure_any(spark, sf_dir):
    return fixpoint.reachable(relation(spark, sf_dir, "provenance"), _ids(spark, 4, 9))


@query
def closure_all(spark, sf_dir):
    return fixpoint.closure(relation(spark, sf_dir, "provenance"), _ids(spark, 4, 9))


@query
def ancestors_sources(spark, sf_dir):
    name = lambda c: F.concat(F.when(F.col(c) % 3 == 0, "sources/").otherwise("concepts/"), F.col(c))
    prov = relation(spark, sf_dir, "provenance").select(name("child").alias("child"), name("parent").alias("parent"))
    return fixpoint.source_ancestors(prov, spark.createDataFrame([("concepts/100",), ("concepts/151",)], "id string"))


@query
def highwater(spark, sf_dir):
    levels = relation(spark, sf_dir, "concepts").select(F.col("doc_id").alias("id"), expr.rank(F.col("sensitivity")).alias("level"), (F.col("doc_id") < 4).alias("is_source"))
    return fixpoint.high_water(relation(spark, sf_dir, "provenance"), levels)


@query
def unresolvable_provenance(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"))
    return fixpoint.unresolved(relation(spark, sf_dir, "provenance"), ids)


@query
def best_raises(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).alias("level"), F.col("l_linenumber").alias("priority"), F.concat(F.lit("p"), "l_linenumber").alias("producer"))
    return fixpoint.best_raises(rows)


# Entity resolution


def _titles(spark, sf_dir, where="true"):
    part = table(spark, sf_dir, "part").filter(where)
    name = F.split_part("p_type", F.lit(" "), F.lit(1))
    return part.select(F.concat(F.lit("part/"), "p_partkey").alias("concept_id"), name.alias("type"), F.when(F.col("p_partkey") % 499 == 0, "STANDARD").alias("type_alternative"), F.col("p_name").alias("title"))


def _eligible(spark, sf_dir, where="true"):
    gone = table(spark, sf_dir, "part").filter("p_size = 50").select(F.concat(F.lit("part/"), "p_partkey").alias("concept_id"))
    return resolution.eligible(_titles(spark, sf_dir, where), gone, ascii_only=True)


@query
def exact_title_groups(spark, sf_dir):
    return resolution.same_title(_eligible(spark, sf_dir)).select("key", F.array_join("member_ids", ",").alias("members"))


@query
def bridge_pairs(spark, sf_dir):
    return resolution.bridge_pairs(_eligible(spark, sf_dir))


@query
def near_match_pairs(spark, sf_dir):
    return resolution.near_pairs(_eligible(spark, sf_dir))


@query
def acronym_pairs(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select(F.concat(F.lit("c/"), "c_custkey").alias("concept_id"), F.lit("Concept").alias("type"), F.lit(None).cast("string").alias("type_alternative"))
    n = F.regexp_extract("concept_id", r"(\d+)$", 1).cast("long")
    nation = F.floor(n / 2) % 26
    letter = lambda k: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (nation * k % 26 + 1).cast("int"), F.lit(1))
    title = F.when(n % 2 == 0, F.concat(F.lit("tool "), letter(1), letter(3), letter(5))).otherwise(F.concat(letter(1), F.lit("one "), letter(3), F.lit("two "), letter(5), F.lit("three")))
    return resolution.acronym_pairs(resolution.eligible(made.withColumn("title", title), made.limit(0), ascii_only=True))


@query
def candidate_report(spark, sf_dir):
    out = resolution.report(_eligible(spark, sf_dir))
    return out.select("tier", "trigger", "type", F.array_join("member_ids", ",").alias("members"), "produced")


@query
def sample_per_type(spark, sf_dir):
    return resolution.sample_by_type(relation(spark, sf_dir, "concepts"))


# Lint


def _stamped(spark, sf_dir):
    made = table(spark, sf_dir, "orders")
    tier = F.element_at(F.split("o_orderpriority", "-"), -1)
    kind = F.when(F.col("o_orderkey") % 4 == 0, "Person").when(F.col("o_orderkey") % 4 == 1, "Project").when(F.col("o_orderkey") % 4 == 2, "Event").otherwise("Other")
    return made.select(
        F.concat(F.lit("orders/"), "o_orderkey").alias("path"),
        kind.alias("type"),
        F.when(tier == "URGENT", "volatile").when(tier == "LOW", "static").alias("volatility"),
        F.when(F.col("o_orderstatus") == "P", "snapshot").alias("freshness"),
        F.concat(F.lit("true (as of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(") and (as of 2001-99-01)")).alias("body"),
    )


@query
def stale_stamps(spark, sf_dir):
    return lint.stale_stamps(lint.window_for(_stamped(spark, sf_dir)), TODAY)


@query
def orphans(spark, sf_dir):
    docs = relation(spark, sf_dir, "nodes").select(F.col("concept_id").alias("path"))
    index = table(spark, sf_dir, "nation").select(F.lit(None).cast("string").alias("source_id"), F.concat(F.lit("nation/"), "n_nationkey").alias("target_id"))
    return lint.orphans(docs, relation(spark, sf_dir, "links").unionByName(index))


@query
def dangling_targets(spark, sf_dir):
    docs = relation(spark, sf_dir, "nodes").select(F.col("concept_id").alias("path"))
    refs = relation(spark, sf_dir, "relations").filter("relation_type <> 'supersedes'").select("source_id", "target_id").unionByName(relation(spark, sf_dir, "links"))
    return lint.dangling(docs, refs)


@query
def dangling_provenance(spark, sf_dir):
    docs = relation(spark, sf_dir, "nodes").select(F.col("concept_id").alias("path"))
    prov = relation(spark, sf_dir, "mirror").select("child", F.concat("parent", F.lit(".md")).alias("parent"), F.lit("orders/14").alias("resource"))
    return lint.dangling_provenance(docs, prov)


@query
def unbacked_relations(spark, sf_dir):
    return lint.unbacked(relation(spark, sf_dir, "relations"), relation(spark, sf_dir, "mirror"))


def _tree(spark, sf_dir):
    return relation(spark, sf_dir, "provenance").filter("parent = floor(child / 2) and (child % 10 <> 7 or parent % 2 = 0)")


def _closures(spark, sf_dir):
    """(source, id): each of the sources 2 to 5 with its own ALL-closure."""
    roots = spark.range(2, 6).select(F.col("id").alias("source"), "id")
    return fixpoint.closures(_tree(spark, sf_dir), roots)


def _levels(spark, sf_dir):
    return relation(spark, sf_dir, "concepts").select(F.col("doc_id").alias("id"), expr.rank(F.when(F.col("doc_id") < 6, "confidential").otherwise(F.col("sensitivity"))).alias("level"))


@query
def below_source(spark, sf_dir):
    return lint.below_source(_closures(spark, sf_dir), _levels(spark, sf_dir))


@query
def multi_source_uncovered(spark, sf_dir):
    return lint.multi_source(_tree(spark, sf_dir), _closures(spark, sf_dir), _levels(spark, sf_dir))


def _leveled(spark, sf_dir):
    level = F.when(F.col("doc_id") < 6, F.when(F.col("doc_id") == 4, "private").otherwise("confidential")).when(F.col("doc_id") % 6 == 0, "secret").otherwise(F.col("sensitivity"))
    return relation(spark, sf_dir, "concepts").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id").between(2, 5), "Source").otherwise("Concept").alias("type"), level.alias("sensitivity"))


@query
def source_raises(spark, sf_dir):
    return fixpoint.source_raises(_tree(spark, sf_dir), _leveled(spark, sf_dir))


@query
def backfill_raises(spark, sf_dir):
    return fixpoint.backfill_raises(_tree(spark, sf_dir), _leveled(spark, sf_dir))


@query
def window_parse(spark, sf_dir):
    made = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size") - 1, F.when(F.col("p_size") % 3 == 0, "w").when(F.col("p_size") % 3 == 1, "d").otherwise("x")).alias("window"))
    return lint.parse_window(made, "window", 7).select("p_partkey", "days", "defaulted")


# State


@query
def manifest_hash(spark, sf_dir):
    return state.manifest_hash(relation(spark, sf_dir, "concepts"))


@query
def content_hash_cdc(spark, sf_dir):
    docs = relation(spark, sf_dir, "concepts").filter("doc_id % 11 <> 0")
    body = F.when(F.col("doc_id") % 7 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    stored = relation(spark, sf_dir, "concepts").filter("doc_id % 5 <> 0").select("concept_id", F.sha2(body, 256).alias("content_hash"))
    return state.classify(docs, stored)


@query
def finding_staleness(spark, sf_dir):
    docs = relation(spark, sf_dir, "concepts")
    d = lambda k, c: F.struct(F.concat(F.lit("documents/"), F.col("doc_id") + k).alias("ref"), c.alias("digest"))
    own = F.sha2("title", 256)
    findings = docs.select(F.col("doc_id").alias("id"), F.array(d(0, own), d(1, F.lit("x"))).alias("input_digests"))
    current = docs.filter("doc_id % 3 <> 0").select(F.col("concept_id").alias("ref"), own.alias("digest"))
    return state.stale(findings, current).select("id", "stale")


@query
def adjudication_supersede(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value")
    return state.supersede(rows, ["user_id", "event_type"])


@query
def catalogue_render(spark, sf_dir):
    return state.catalogue(relation(spark, sf_dir, "concepts")).select("section", F.sha2("body", 256).alias("body_sha256"))


@query
def recent_log(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderkey").alias("pos"), "o_orderpriority")
    return state.recent_log(log, 25)


def _ledger(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("survivor_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("a"), "l_linenumber").alias("absorbed_id"))
    history = F.transform(F.sequence(F.lit(1), F.greatest(F.col("seq") - 1, F.lit(1))), lambda i: F.concat(F.lit("a"), i))
    return item.distinct().withColumn("history", F.when(F.col("seq") == 1, F.array().cast("array<string>")).otherwise(history))


@query
def nesting_violations(spark, sf_dir):
    return state.nesting_violations(_ledger(spark, sf_dir))


@query
def unwind_sequence(spark, sf_dir):
    return state.unwind(_ledger(spark, sf_dir).drop("history").withColumn("survivor_id", F.col("survivor_id").cast("string")), "7", "a2").select("seq", "absorbed_id")


@query
def torn_writes(spark, sf_dir):
    docs = relation(spark, sf_dir, "concepts")
    pending = docs.filter("doc_id % 9 = 0").select(F.col("concept_id").alias("survivor_id"), F.sha2(F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise("x"), 256).alias("expected_hash"))
    current = docs.filter("doc_id % 4 <> 0").select("concept_id", F.sha2("title", 256).alias("content_hash"))
    return state.torn_writes(pending, current)


@query
def basename_collisions(spark, sf_dir):
    return state.collisions(table(spark, sf_dir, "customer").select(F.concat(F.lit("raw/"), "c_custkey", F.lit("/"), "c_mktsegment", F.lit("-"), "c_nationkey", F.lit(".md")).alias("path")))


@query
def slugs(spark, sf_dir):
    return state.slugs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))).select("id", "slug")


# Summaries


@query
def survey_by_type(spark, sf_dir):
    return summaries.survey(relation(spark, sf_dir, "concepts"))


@query
def list_objects(spark, sf_dir):
    concepts = relation(spark, sf_dir, "concepts")
    return summaries.list_objects(concepts, policy.deprecated(concepts, relation(spark, sf_dir, "relations")))


def _objects(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("source"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("type"), expr.key_ascii(F.col("p_name")).alias("key"), F.repeat(F.lit("b"), F.col("p_size")).alias("body"), F.col("p_brand").alias("description"), F.col("p_partkey").alias("pos"))


@query
def union_merge(spark, sf_dir):
    return summaries.union_merge(_objects(spark, sf_dir)).select("source", "type", "key", "pos", "first_pos")


@query
def first_wins_merge(spark, sf_dir):
    return summaries.first_wins(_objects(spark, sf_dir)).select("source", "type", "key", "pos")


@query
def judge_admission(spark, sf_dir):
    made = _objects(spark, sf_dir)
    kind = F.when(F.col("type") == "PROMO", "Procedure").when(F.col("type") == "LARGE", "Person").otherwise("Concept")
    candidates = made.select("source", "key", kind.alias("type"), "pos", (F.col("source") % 2 == 0).alias("meeting"))
    selected = made.filter("source % 4 <> 3 and pos % 5 = 0").select("source", "key")
    return summaries.judge_admission(candidates, selected).select("source", "key", "type", "pos")


@query
def next_action_rank(spark, sf_dir):
    concepts = relation(spark, sf_dir, "concepts")
    tiers = [
        concepts.agg(F.lit(1).alias("tier"), F.lit("unreadable").alias("subject"), F.count_if(F.col("body").isNull()).alias("n")),
        concepts.agg(F.lit(2).alias("tier"), F.lit("contradiction").alias("subject"), F.count_if(F.col("body").contains("never-there")).alias("n")),
        concepts.groupBy().agg(F.lit(3).alias("tier"), F.lit("sensitivity-gap").alias("subject"), F.count_if(F.col("sensitivity").isNull()).alias("n")),
        concepts.agg(F.lit(4).alias("tier"), F.lit("deprecated").alias("subject"), F.count_if(F.col("status") == "deprecated").alias("n")),
    ]
    return summaries.next_action(summaries.all_of(tiers))


def _transcripts(spark, sf_dir):
    """Documents as they are, and conversations written out as `label: text` lines; labels of every fifth conversation are shouted,
    every seventh has a line of prose after each turn."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.lit("Notes").alias("title"), F.col("text").alias("body"))
    conv = F.col("conv_id")
    role = F.when(conv % 5 == 0, F.upper("role")).otherwise(F.col("role"))
    line = F.concat(role, F.lit(": "), F.regexp_replace("text", r"[\r\n]+", " "), F.when(conv % 7 == 0, "\nand so on, at length\nand more").otherwise(""))
    turns = table(spark, sf_dir, "conversations").filter("conv_id is not null").withColumn("line", F.concat(line, F.lit("\n"), line, F.lit("\n"), line))
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "line")))
    chats = turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))
    return docs.unionByName(chats.select((-1 - F.col("conv_id")).alias("doc_id"), F.when(F.col("conv_id") % 3 == 0, "Weekly standup").otherwise("Chat").alias("title"), "body"))


@query
def transcript_shape(spark, sf_dir):
    return summaries.transcript_shape(_transcripts(spark, sf_dir))


@query
def dominant_language(spark, sf_dir):
    return summaries.dominant_language(relation(spark, sf_dir, "concepts")).select("doc_id", "n_en", "n_es", "language")


@query
def extraction_cost(spark, sf_dir):
    sources = summaries.meeting_shaped(_transcripts(spark, sf_dir)).withColumn("concept_id", F.concat(F.lit("sources/"), F.col("doc_id").cast("string")))
    return summaries.extraction_cost(sources)


@query
def verdict_parse(spark, sf_dir):
    made = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", " contradicts ").when(F.col("event_type") == "view", "consistent").otherwise(F.col("event_type")).alias("verdict"), F.when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).when(F.col("event_id") % 11 == 1, F.lit(float("nan"))).otherwise(F.col("value") / 50).alias("confidence"), F.when(F.col("user_id") % 3 == 0, F.array(F.lit("c"), F.lit(" "))).when(F.col("user_id") % 3 == 1, F.array(F.lit(" "), F.lit(None))).alias("claims"))
    return _rounded(summaries.verdicts(made).select("event_id", "verdict", "confidence"), "confidence")


@query
def resource_shape(spark, sf_dir):
    made = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 6 == 0, "raw/a.md").when(F.col("p_size") % 6 == 1, "raw/../a").when(F.col("p_size") % 6 == 2, "raw\\a").when(F.col("p_size") % 6 == 3, " ").when(F.col("p_size") % 6 == 4, "raw/a/b").alias("resource"))
    return made.select("p_partkey", summaries.resource_reason(F.col("resource")).alias("reason"))


@query
def titleize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", expr.titleize(F.concat(F.lit("-"), F.replace("p_type", F.lit(" "), F.lit("_-")), F.lit("__"))).alias("title"))


@query
def decision_keys(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", expr.short_key(F.col("n_name"), F.concat(F.lit("region/"), "n_regionkey")).alias("decision_key"))


@query
def merge_relations(spark, sf_dir):
    r = lambda t, k: F.struct(F.concat(F.lit("n/"), t).alias("target"), F.lit(k).alias("type"))
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    out = summaries.merged_relations(F.array(r(region, "part_of"), r(key + 1, "references"), r(key, "depends_on"), r(F.lit(99), "references")), F.array(r(key, "references"), r(region, "part_of"), r(key + 1, "references"), r(F.lit(99), "part_of")), F.concat(F.lit("n/"), key), F.lit("n/99"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(out, lambda x: F.concat_ws(":", x["target"], x["type"])), ",").alias("relations"))


@query
def union_dedup_lists(spark, sf_dir):
    one = F.array(F.col("p_brand"), F.col("p_name"), F.col("p_brand"))
    two = F.array(F.col("p_type"), F.col("p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(summaries.merged_list(one, two), "|").alias("merged"))


# Replies and findings


def _json(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


@query
def object_validation(spark, sf_dir):
    n, kind = F.col("event_id"), F.col("event_type")
    type_ = F.when(n % 7 == 0, '"Source"').when(n % 7 == 1, '"Person"').when(n % 7 == 2, "5").when(n % 7 == 3, '" Concept"').otherwise('"Concept"')
    title = F.when(n % 11 == 0, '"  "').when(n % 11 == 1, "null").otherwise(_json('" ', kind, ' "'))
    body = F.when(n % 5 == 0, "").when(n % 5 == 1, ', "body": null').when(n % 5 == 2, ', "body": ["x"]').otherwise(_json(', "body": "', kind, '"'))
    extract = F.when(n % 13 == 0, ', "extract": false').when(n % 13 == 1, ', "extract": true').otherwise("")
    other = F.when(n % 3 == 0, '"Person"').when(n % 3 == 1, '"Concept"').otherwise("7")
    item = _json('{"type": ', type_, ', "title": ', title, ', "description": "d', n, '"', body, extract, ', "type_alternative": ', other, "}")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n % 17 == 0, "not json").otherwise(item).alias("item"))
    return replies.valid_objects(rows).select("event_id", "type", "title", "description", "body", "type_alternative")


@query
def relation_suggestions(spark, sf_dir):
    n = F.col("event_id")
    type_ = F.when(n % 6 == 0, '" part_of "').when(n % 6 == 1, '"derived_from"').when(n % 6 == 2, '" "').when(n % 6 == 3, "[1]").otherwise(_json('"', F.col("event_type"), '"'))
    why = F.when(n % 4 == 0, "").when(n % 4 == 1, ', "rationale": " "').otherwise(_json(', "rationale": "r', F.col("user_id"), '"'))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n % 19 != 0, _json('{"type": ', type_, why, "}")).alias("reply"))
    return replies.relation_suggestions(rows).select("event_id", "suggested_type", "rationale")


@query
def volatility_suggestions(spark, sf_dir):
    n = F.col("p_partkey")
    tier = F.when(n % 4 == 0, '"slow "').when(n % 4 == 1, '"Static"').when(n % 4 == 2, "true").otherwise('"volatile"')
    rows = table(spark, sf_dir, "part").select("p_partkey", _json('{"tier": ', tier, ', "rationale": "', F.when(n % 3 == 0, "").otherwise(F.col("p_brand")), '"}').alias("reply"))
    return replies.volatility_suggestions(rows).select("p_partkey", "suggested_tier", "rationale")


@query
def high_confidence_findings(spark, sf_dir):
    made = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "CONTRADICTS").otherwise("consistent").alias("verdict"), expr.confidence(F.col("value") / 50).alias("confidence"))
    return replies.high_confidence(made).select("event_id")


@query
def type_alias(spark, sf_dir):
    objects = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "people").when(F.col("p_size") % 3 == 1, "concepts").otherwise("sources").alias("link_dir"))
    asked = [replies.of_type(objects, w).withColumn("asked", F.lit(w)) for w in ("people", "Person", "person", "Source")]
    return summaries.all_of(asked).groupBy("asked", "link_dir").agg(F.count(F.lit(1)).alias("n"))


@query
def undeclined_findings(spark, sf_dir):
    member = lambda c, k: F.concat(F.lit("c/"), F.col(c) + k)
    findings = table(spark, sf_dir, "orders").select("o_orderkey", F.array(member("o_custkey", 1), member("o_custkey", 0)).alias("members"))
    made = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 2").withColumn("m", F.array(member("c_custkey", 0), member("c_custkey", 1)))
    first = made.select(replies.short_key_of("m").alias("decision_key"), F.lit("declined").alias("state"), F.lit(1).alias("at"))
    again = made.filter("c_custkey % 3 = 0").select(replies.short_key_of("m"), F.lit("open"), F.lit(2))
    return replies.undeclined(findings, first.union(again)).select("o_orderkey")


def _snapshots(spark, sf_dir):
    keys = _ledger(spark, sf_dir).drop("history")
    name = F.concat(F.lit("orders/"), "survivor_id")
    return keys.select(name.alias("survivor_id"), "seq", "absorbed_id", F.concat(F.lit("before "), "seq").alias("survivor_before"), F.concat(F.lit("body of "), "absorbed_id").alias("absorbed_snapshot"))


@query
def merged_body_candidates(spark, sf_dir):
    concepts = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").select(F.concat(F.lit("orders/"), "o_orderkey").alias("concept_id"))
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("orders/"), "o_orderkey").alias("concept_id"))
    out = replies.merged_bodies(_snapshots(spark, sf_dir), concepts, gone)
    return out.select("survivor_id", "seq", F.array_join(F.transform("input_digests", lambda d: F.concat(d["ref"], F.lit("="), F.substring(d["digest"], 1, 8))), ",").alias("digests"))


@query
def served_verdicts(spark, sf_dir):
    docs = relation(spark, sf_dir, "concepts").select(F.col("concept_id").alias("ref"), F.sha2("title", 256).alias("digest"), "doc_id")
    there = docs.filter("doc_id % 7 <> 0").select("ref", "digest")
    other = F.concat(F.lit("documents/"), F.col("doc_id") + 1)
    pairs = docs.select("doc_id", F.col("ref").alias("id_a"), other.alias("id_b"), F.when(F.col("doc_id") % 2 == 0, "part_of").alias("relation_type"))
    now = replies.input_digests(pairs, there)
    was = replies.input_digests(pairs.withColumn("relation_type", F.when(F.col("doc_id") % 3 == 0, "references").otherwise(F.col("relation_type"))), there)
    old = was.select("doc_id", F.lit(1).alias("id"), F.lit("old").alias("verdict"), F.expr("cast(array() as array<struct<ref: string, digest: string>>)").alias("input_digests"))
    kept = old.union(was.filter("doc_id % 5 <> 0").select("doc_id", F.lit(2), F.lit("new"), "input_digests"))
    return replies.served(now, kept, ["doc_id"]).select("doc_id", F.size("input_digests").alias("n_inputs"), "verdict")


@query
def deepest_stack(spark, sf_dir):
    return replies.deepest_stack(_ledger(spark, sf_dir))


@query
def sensitivity_gaps(spark, sf_dir):
    none = F.when(F.col("doc_id") % 4 == 0, "bad bytes")
    return replies.sensitivity_gaps(relation(spark, sf_dir, "concepts").withColumn("read_error", none).withColumn("parse_error", F.lit(None).cast("string")))


# Text kernels


@query
def chunk_windows(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text_udfs.chunk_lines("text")).alias("window", "chunk"))
    return cut.select("doc_id", "window", F.length("chunk").alias("n_chars"))


@query
def evidence_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("body_id"), F.col("text").alias("body"))
    return lexical.evidence_pairs(items, docs).select(F.col("source_id").alias("doc_id"), F.col("body_id").alias("item_id"), "evidence")


@query
def json_replies(spark, sf_dir):
    wrapped = F.concat(F.lit("Here it is:\n```json\n{\"event\": "), F.col("event_id"), F.lit(", \"props\": \""), F.col("event_type"), F.lit("\"}\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", text_udfs.extract_json(wrapped).alias("object"))


@query
def attribution_split(spark, sf_dir):
    reply = F.concat(F.lit("Answer "), F.col("event_id"), F.lit("\nUSED: "), F.when(F.col("event_id") % 13 == 0, "None").when(F.col("event_id") % 13 == 1, "").otherwise(F.concat(F.col("event_id") % 7, F.lit(", "), F.col("user_id") % 5)))
    out = table(spark, sf_dir, "events").select("event_id", text_udfs.split_attribution(reply, F.lit(4)).alias("a"))
    return out.select("event_id", "a.prose", "a.status", F.array_join(F.transform("a.used", lambda x: x.cast("string")), ",").alias("used"))


@query
def streaming_latest(spark, sf_dir):
    from cairn.streaming import verdicts

    return verdicts.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type", "value")


def _rounded(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))

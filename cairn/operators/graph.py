"""The typed graph: body links, provenance mirror, typed relations, candidates, contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINK = r"\[[^\]]*\]\(/([^)\s#]+\.md)(?:#[^)]*)?\)"


def body_links(concepts: DataFrame) -> DataFrame:
    """(source_id, target_id) of absolute document links; mask fences first."""
    found = concepts.select(F.col("concept_id").alias("source_id"), F.explode(F.regexp_extract_all("body", F.lit(LINK), F.lit(1))).alias("target"))
    return found.select("source_id", F.regexp_replace("target", r"\.md$", "").alias("target_id")).distinct()


def edges(nodes: DataFrame, links: DataFrame, relations: DataFrame, provenance: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type): a multigraph. Links are untyped unless the source's provenance names the target
    (derived_from); typed relations stand beside them. Targets must exist; self-links stay."""
    known = nodes.select(F.col("concept_id").alias("target_id")).distinct()
    mirror = provenance.select(F.col("child").alias("source_id"), F.col("parent").alias("target_id"), F.lit("derived_from").alias("relation_type")).distinct()
    linked = links.select("source_id", "target_id").distinct().join(known, "target_id", "left_semi").join(mirror, ["source_id", "target_id"], "left")
    typed = relations.select("source_id", "target_id", "relation_type").distinct().join(known, "target_id", "left_semi")
    names = ["source_id", "target_id", "relation_type"]
    return linked.select(names).union(typed.select(names)).distinct()


def summary(edges: DataFrame, concept_dirs: list[str]) -> DataFrame:
    """One row (total, typed) of edges between concept nodes."""
    inside = F.split_part("source_id", F.lit("/"), F.lit(1)).isin(concept_dirs) & F.split_part("target_id", F.lit("/"), F.lit(1)).isin(concept_dirs)
    return edges.filter(inside).agg(F.count(F.lit(1)).alias("total"), F.count("relation_type").alias("typed"))


def untyped_candidates(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Untyped edges whose directed pair has no typed edge and neither of whose ends is blocked."""
    typed = edges.filter("relation_type is not null").select("source_id", "target_id").distinct()
    out = edges.filter("relation_type is null").select("source_id", "target_id").distinct().join(typed, ["source_id", "target_id"], "left_anti")
    for end in ("source_id", "target_id"):
        out = out.join(blocked.select(F.col("concept_id").alias(end)), end, "left_anti")
    return out.select("source_id", "target_id")


def candidate_edges(pairs: DataFrame, edges: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Proximity pairs not linked in either direction, the band [offset, offset + limit) by (distance, pair)."""
    linked = edges.select(F.least("source_id", "target_id").alias("id_a"), F.greatest("source_id", "target_id").alias("id_b")).distinct()
    free = pairs.groupBy("id_a", "id_b").agg(F.min("distance").alias("distance")).join(linked, ["id_a", "id_b"], "left_anti")
    top = free.orderBy("distance", "id_a", "id_b").limit(offset + limit)
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("distance", "id_a", "id_b"))
    return top.withColumn("place", place).filter(F.col("place") > offset).select("id_a", "id_b", "distance")


def _undirected(edges: DataFrame) -> DataFrame:
    typed = edges.filter("relation_type is not null and source_id <> target_id")
    return typed.withColumn("id_a", F.least("source_id", "target_id")).withColumn("id_b", F.greatest("source_id", "target_id"))


def contradiction_pairs(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """(id_a, id_b): unordered pairs of typed edges but derived_from, no self-loops, no end excluded."""
    out = _undirected(edges.filter("relation_type <> 'derived_from'")).select("id_a", "id_b").distinct()
    for end in ("id_a", "id_b"):
        out = out.join(excluded.select(F.col("concept_id").alias(end)), end, "left_anti")
    return out.select("id_a", "id_b")


def pair_labels(edges: DataFrame) -> DataFrame:
    """(id_a, id_b, relation_type): the first type by (source, target, type), any other before derived_from."""
    order = F.struct((F.col("relation_type") == "derived_from").alias("d"), "source_id", "target_id", "relation_type")
    return _undirected(edges).groupBy("id_a", "id_b").agg(F.min(order).alias("o")).select("id_a", "id_b", F.col("o.relation_type").alias("relation_type"))


def budget(pairs: DataFrame, merged: DataFrame, total: int = 200, floor: int = 50) -> DataFrame:
    """(kind, id_a, id_b): edge pairs first, with room kept for up to floor merged bodies, then merged ones in what is left."""
    n_merged = F.lit(merged.limit(total).count())
    room = F.lit(total) - F.least(F.lit(floor), n_merged)
    by = W.partitionBy(F.lit(1)).orderBy("id_a", "id_b")
    first = pairs.orderBy("id_a", "id_b").limit(total).withColumn("n", F.row_number().over(by)).filter(F.col("n") <= room)
    kept = first.count()
    then = merged.orderBy("id_a", "id_b").limit(max(total - kept, 0))
    return first.select(F.lit("edge").alias("kind"), "id_a", "id_b").union(then.select(F.lit("merged"), "id_a", "id_b"))


def simple_digraph(edges: DataFrame) -> DataFrame:
    """One edge per directed pair; of parallel types the last in order stays, so a typed edge wins over an untyped one."""
    return edges.groupBy("source_id", "target_id").agg(F.max("relation_type").alias("relation_type"))


def adjacency(edges: DataFrame, concept_id: str) -> DataFrame:
    """Targets of one node in order, parallel edges repeated."""
    return edges.filter(F.col("source_id") == concept_id).select("target_id", "relation_type").orderBy("target_id", F.col("relation_type").asc_nulls_first())


def inbound(concept_id: str, links: DataFrame, relations: DataFrame, unparsed: DataFrame) -> DataFrame:
    """(source_id, how) of what refers to a document: links, relations, and unparsable documents whose text holds its id; itself left out."""
    a = links.filter(F.col("target_id") == concept_id).select("source_id", F.lit("link").alias("how"))
    b = relations.filter(F.col("target_id") == concept_id).select("source_id", F.lit("relation").alias("how"))
    c = unparsed.filter(F.col("body").contains(concept_id)).select(F.col("concept_id").alias("source_id"), F.lit("unverifiable").alias("how"))
    return a.union(b).union(c).filter(F.col("source_id") != concept_id).distinct()

"""Models' replies made safe, and what is kept of findings: all as expressions over JSON text and joins.

Replies come as the JSON object of a reply (text_udfs.extract_json, or an item of extract_items); null where there was none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.vocabulary import ENGINE_RELATIONS, OBJECT_TYPES, TIERS

BLANKS = " \t\n\r\x0b\x0c"
CLASSIFIABLE = [t[0] for t in OBJECT_TYPES if t[3]]

# Rationales of suggestions that were refused.
MALFORMED = "malformed reply: could not parse a valid suggestion JSON object"
DEGRADED = "no rationale provided for a fail-closed degrade"
ENGINE_OWNED = "refused: this type records provenance, which the engine derives from the document's own provenance field -- a suggested one cannot be told apart from a real one"


def _kind(key: str) -> Column:
    """The JSON type of a key's value; null where the key is absent."""
    return F.expr(f"schema_of_variant(try_variant_get(_v, '$.{key}', 'variant'))")


def _text(key: str) -> Column:
    """A key's value where it is text."""
    return F.when(_kind(key) == "STRING", F.expr(f"try_variant_get(_v, '$.{key}', 'string')"))


def _stripped(x: Column) -> Column:
    """Without white space around; null where nothing is left."""
    x = F.btrim(x, F.lit(BLANKS))
    return F.when(x != "", x)


def valid_objects(items: DataFrame, column: str = "item") -> DataFrame:
    """items with type, title, description, body and type_alternative, of those that are objects to keep.

    An explicit `extract: false`, a type that models may not assign, a title or description that is blank or no text, and a body that is no text
    drop the item; a missing body is empty. An alternative that is no such type, or the type itself, is null.
    """
    v = items.withColumn("_v", F.try_parse_json(column))
    v = v.withColumn("type", _text("type")).withColumn("title", _stripped(_text("title"))).withColumn("description", _stripped(_text("description")))
    refused = (_kind("extract") == "BOOLEAN") & ~F.expr("try_variant_get(_v, '$.extract', 'boolean')")
    v = v.withColumn("body", F.when(_kind("body").isNull(), "").otherwise(_text("body"))).withColumn("_no", F.coalesce(refused, F.lit(False)))
    other = _text("type_alternative")
    v = v.withColumn("type_alternative", F.when(other.isin(CLASSIFIABLE) & (other != F.col("type")), other))
    return v.filter(F.col("type").isin(CLASSIFIABLE) & F.col("title").isNotNull() & F.col("description").isNotNull() & F.col("body").isNotNull() & ~F.col("_no")).drop("_v", "_no")


def _suggested(replies: DataFrame, column: str, key: str, accept: Column, name: str) -> DataFrame:
    v = replies.withColumn("_v", F.try_parse_json(column)).withColumn("_s", _stripped(_text(key))).withColumn("_r", F.coalesce(_text("rationale"), F.lit("")))
    kept = F.when(accept, F.col("_s"))
    spoken = F.when(F.btrim("_r", F.lit(BLANKS)) == "", DEGRADED).otherwise(F.col("_r"))
    owned = F.col("_s").isin(*ENGINE_RELATIONS) if name == "suggested_type" else F.lit(False)
    rationale = F.when(F.col("_v").isNull(), MALFORMED).when(owned, ENGINE_OWNED).when(kept.isNull(), spoken).otherwise(F.col("_r"))
    return v.withColumn(name, kept).withColumn("rationale", rationale).drop("_v", "_s", "_r")


def relation_suggestions(replies: DataFrame, column: str = "reply") -> DataFrame:
    """replies with suggested_type and rationale: any type that isn't blank, but those that only the engine writes."""
    return _suggested(replies, column, "type", F.col("_s").isNotNull() & ~F.col("_s").isin(*ENGINE_RELATIONS), "suggested_type")


def volatility_suggestions(replies: DataFrame, column: str = "reply") -> DataFrame:
    """replies with suggested_tier and rationale: only tiers of the vocabulary."""
    return _suggested(replies, column, "tier", F.col("_s").isin(*TIERS), "suggested_tier")


def high_confidence(findings: DataFrame, least: float = 0.7) -> DataFrame:
    """Findings (verdict, confidence) that contradict with that confidence at least."""
    return findings.filter((F.lower("verdict") == "contradicts") & (F.col("confidence") >= least))


def of_type(objects: DataFrame, wanted: str) -> DataFrame:
    """Objects (link_dir) of a type, named by its directory or, in its own spelling, by its name; none for any other word."""
    dirs = [t[1] for t in OBJECT_TYPES]
    found = wanted if wanted in dirs else next((t[1] for t in OBJECT_TYPES if t[0] == wanted), None)
    return objects.filter(F.col("link_dir") == found) if found else objects.limit(0)


def undeclined(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings (members array) without those whose exact set of members was last declined. decisions: decision_key, state, at."""
    last = decisions.groupBy("decision_key").agg(F.max_by("state", "at").alias("_state")).filter("_state = 'declined'")
    keyed = findings.withColumn("decision_key", short_key_of("members"))
    return keyed.join(last, "decision_key", "left_anti").select(*findings.columns)


def short_key_of(members: str) -> Column:
    """The key of a set of members, in any order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.col(members)), "\0"), 256), 1, 32)


def merged_bodies(ledger: DataFrame, concepts: DataFrame, deprecated: DataFrame) -> DataFrame:
    """(survivor_id, seq, absorbed_id, input_digests): one candidate for each ledger entry of a survivor that exists and isn't deprecated, to compare
    survivor_before with absorbed_snapshot; input_digests are of these two."""
    own = concepts.select(F.col("concept_id").alias("survivor_id")).join(deprecated.select(F.col("concept_id").alias("survivor_id")), "survivor_id", "left_anti")
    digest = lambda ref, suffix, text: F.struct(F.concat(F.col(ref), F.lit(suffix)).alias("ref"), F.sha2(text, 256).alias("digest"))
    both = F.array(digest("survivor_id", ":survivor_before", "survivor_before"), digest("absorbed_id", ":absorbed_snapshot", "absorbed_snapshot"))
    return ledger.join(own, "survivor_id", "left_semi").select("survivor_id", "seq", "absorbed_id", both.alias("input_digests"))


def input_digests(pairs: DataFrame, current: DataFrame) -> DataFrame:
    """pairs (id_a, id_b, relation_type) with input_digests: of both documents, but for those that are gone, and of the relation's type."""
    at = lambda k: current.select(F.col("ref").alias(k), F.col("digest").alias(f"_{k}"))
    held = pairs.join(at("id_a"), "id_a", "left").join(at("id_b"), "id_b", "left")
    one = lambda ref, digest: F.when(digest.isNotNull(), F.struct(ref.alias("ref"), digest.alias("digest")))
    given = F.array(one(F.col("id_a"), F.col("_id_a")), one(F.col("id_b"), F.col("_id_b")), one(F.lit("relation_type"), F.sha2("relation_type", 256)))
    return held.withColumn("input_digests", F.filter(given, lambda x: x.isNotNull())).select(*pairs.columns, "input_digests")


def served(candidates: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """candidates (key, input_digests) with the verdict of the last finding (key, id, verdict, input_digests) made from just these inputs; null: to judge."""
    sorted_ = lambda df: df.withColumn("_d", F.array_sort("input_digests"))
    last = verdicts.groupBy(*key).agg(F.max_by(F.struct("verdict", "input_digests"), "id").alias("_l")).select(*key, "_l.verdict", F.array_sort("_l.input_digests").alias("_d"))
    return sorted_(candidates).join(last, [*key, "_d"], "left").drop("_d")


def deepest_stack(ledger: DataFrame) -> DataFrame:
    """One row: the largest number of entries that a survivor has; 0 for an empty ledger."""
    counts = ledger.groupBy("survivor_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_entries"))


def sensitivity_gaps(concepts: DataFrame) -> DataFrame:
    """concept_id of documents that can be read and name no sensitivity; a blank one is named."""
    return concepts.filter("sensitivity is null and read_error is null and parse_error is null").select("concept_id")


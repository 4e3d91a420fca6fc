"""Deprecation and egress: which documents may be shown or sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.expr import blocks_send, combine, strict_rank


def deprecated(concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """concept_id of what is deprecated itself or the target of another document's `supersedes`: one hop, whatever the superseder's state."""
    own = concepts.filter(F.col("status") == "deprecated").select("concept_id")
    hit = relations.filter((F.col("relation_type") == "supersedes") & (F.col("source_id") != F.col("target_id"))).select(F.col("target_id").alias("concept_id"))
    return own.union(hit).distinct()


def sensitive(concepts: DataFrame, threshold: str = "confidential", include_confidential: bool = False, local_exemption: bool = False) -> DataFrame:
    """concept_id of what must not be sent; none if the caller may see all."""
    ids = concepts.select("concept_id", "sensitivity")
    if include_confidential or local_exemption:
        return ids.limit(0).select("concept_id")
    return ids.filter(blocks_send(F.col("sensitivity"), threshold)).select("concept_id")


def merged_blocked(merged: DataFrame, a: str, b: str, c: str, threshold: int = 2) -> DataFrame:
    """merged with blocked: whether the strictest of three levels, blanks as the highest, is at the threshold."""
    return merged.withColumn("blocked", F.greatest(*[strict_rank(F.col(x)) for x in (a, b, c)]) >= threshold)


def combined(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("combined", combine(F.col(a), F.col(b)))

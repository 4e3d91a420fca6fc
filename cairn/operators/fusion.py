"""Reciprocal rank fusion and the order of operations around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 60
INSIGHT_WEIGHT = 0.5


def is_insight(concept_id: Column) -> Column:
    return concept_id.startswith("insights/")


def fuse(*channels: DataFrame, limit: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(concept_id, score, rank): sum over channels of 1 / (K + rank), insights at half weight; ties by id.

    Each channel has concept_id and rank (positions from 1). An id that a channel repeats counts
    at its first position only; the repeat still takes a position. by: columns, such as a query id, to fuse within.
    """
    by = by or []
    parts = None
    for c in channels:
        one = c.groupBy(*by, "concept_id").agg(F.min("rank").alias("rank"))
        parts = one if parts is None else parts.unionByName(one)
    weight = F.when(is_insight(F.col("concept_id")), INSIGHT_WEIGHT).otherwise(1.0)
    scored = parts.groupBy(*by, "concept_id").agg(F.round(F.sum(1.0 / (K + F.col("rank"))), 12).alias("score"))
    scored = scored.withColumn("score", F.col("score") * weight)
    order = [F.desc("score"), F.col("concept_id")]
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(*(by or [F.lit(1)])).orderBy(*order)))
    return ranked if limit is None else ranked.filter(F.col("rank") <= max(limit, 0))


def excluded(hits: DataFrame, ids: DataFrame, order: list[str]) -> DataFrame:
    """hits without ids, ranked anew: applied after each channel's limit, so fewer may be left."""
    left = hits.drop("rank").join(ids.select("concept_id").distinct(), "concept_id", "left_anti")
    return left.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))

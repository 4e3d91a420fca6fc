"""Mixing sources to target weights by a periodic Pfair schedule.

Weights become integer shares of a period of slots. Block i of a source with c
shares of a period D is released at floor((i - 1) D / c) and due at ceil(i D / c);
earliest deadline first among released blocks fills every slot in time, which
keeps each source within one block of its target at every prefix. The schedule
repeats, so only one period is simulated on the driver; a document's slot is
then arithmetic on its index in its source.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Schedules of at most so many slots (of a source's name and two numbers each) are broadcast.
BROADCAST_ROWS = 20_000


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Integer shares of the period by largest remainder, one at least; ties go to the smaller name."""
    period = max(period, len(weights))
    total = sum(weights.values())
    free = period - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    left = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:left]:
        out[s] += 1
    return out


def pfair(share: dict[str, int]) -> list[str]:
    """The source of each slot of one period."""
    period = sum(share.values())
    waiting = [(0, -(-period // c), s, 1) for s, c in sorted(share.items())]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i))
        due, s, i = heapq.heappop(ready)
        slots.append(s)
        c = share[s]
        heapq.heappush(waiting, (i * period // c, -(-(i + 1) * period // c), s, i + 1))
    return slots


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_docs: int = 16,
    period: int = 1024,
    bucket_docs: int = 2_000,
) -> DataFrame:
    """docs with mix_source, mix_block, mix_slot and mix_pos; sort by (mix_slot, mix_pos) to read the mixture.

    weights: target weight of each source, positive; by default the square root of its
    number of documents. A source without a weight gets the smallest given one. Documents
    of a source are taken in the order of md5(doc_id), then doc_id, then the other columns'
    digest; rows that are alike are interchangeable. Every row is kept: when a source has no
    block left its slots stay empty and the others keep theirs, so the bound of one block holds
    until the first source runs out. A null source counts as ''. An empty table gives no rows.
    Existing columns called mix_* are replaced. Only the sources and their counts reach the driver.
    """
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_pos")
    keyed = docs.withColumn("mix_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    counts = {r[0]: r[1] for r in keyed.groupBy("mix_source").count().collect()}
    spark = docs.sparkSession
    if not counts:
        counts = {"": 1}
    if weights is None:
        weights = {s: n**0.5 for s, n in counts.items()}
    least = min(weights.values())
    share = shares({s: weights.get(s, least) for s in counts}, period)
    slots = pfair(share)
    seen: dict[str, int] = {}
    rows = []
    for slot, s in enumerate(slots):
        rows.append((s, seen.get(s, 0), slot))
        seen[s] = seen.get(s, 0) + 1
    small = (lambda df: F.broadcast(df)) if len(rows) <= BROADCAST_ROWS else (lambda df: df)  # longer schedules, of more sources than that, are joined
    plan = small(spark.createDataFrame(rows, "mix_source string, _turn long, _slot long"))
    share_of = small(spark.createDataFrame([(s, c) for s, c in share.items()], "mix_source string, _share long"))

    digits = 1
    while max(counts.values()) > bucket_docs * 16**digits and digits < 8:
        digits += 1
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = keyed.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits)).withColumn("_tie", tie)
    sizes = keyed.groupBy("mix_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("mix_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("mix_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("mix_source", "_bucket").orderBy("_key", F.col("doc_id"), "_tie")
    placed = (
        keyed.withColumn("_index", F.row_number().over(inside) - 1)
        .join(sizes, ["mix_source", "_bucket"])
        .withColumn("_index", F.col("_index") + F.col("_offset"))
        .withColumn("mix_block", F.floor(F.col("_index") / block_docs).cast("long"))
        .withColumn("mix_pos", (F.col("_index") % block_docs).cast("long"))
    )
    return (
        placed.join(share_of, "mix_source")
        .withColumn("_turn", F.col("mix_block") % F.col("_share"))
        .join(plan, ["mix_source", "_turn"])
        .withColumn("mix_slot", F.floor(F.col("mix_block") / F.col("_share")).cast("long") * len(slots) + F.col("_slot"))
        .select(*[F.col(f"`{c}`") for c in docs.columns], "mix_source", "mix_block", "mix_slot", "mix_pos")
    )

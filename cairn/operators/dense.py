"""Dense search: exact nearest neighbours, proximity pairs, near-duplicate questions, the vector store."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.lexical import ranked


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(concept_id, distance, rank) of the k nearest by Euclidean distance to one query; ties by id. One scan, no shuffle but the top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    total = F.aggregate(F.zip_with("embedding", q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return ranked(vectors.select("concept_id", F.round(F.sqrt(total), 9).alias("distance")), [F.col("distance"), F.col("concept_id")], k)


class _Nearest:
    """The k nearest so far of each of a task's vectors: by distance to 9 places, then name; what isn't a number ranks last."""

    def __init__(self, names: np.ndarray, x: np.ndarray, k: int):
        self.names, self.x, self.k = names, x, k
        self.squares = (x * x).sum(1)
        self.found = np.full((len(x), k), "", dtype=object)
        self.distance = np.full((len(x), k), np.nan)
        self.empty = np.ones((len(x), k), bool)

    def offer(self, names: np.ndarray, y: np.ndarray, step: int = 1024) -> None:
        y2 = (y * y).sum(1)
        for a in range(0, len(self.x), step):
            rows = slice(a, min(a + step, len(self.x)))
            x, x2 = self.x[rows], self.squares[rows]
            squares = x2[:, None] - 2 * x @ y.T + y2[None]
            #: Above what the product's rounding and that of the distances to 9 places can hide.
            slack = 4 * (x.shape[1] + 4) * np.finfo(float).eps * (x2 + np.nanmax(y2, initial=0))
            m = min(len(y), self.k)
            most = np.partition(squares, m - 1, axis=1)[:, m - 1] + slack  # partition puts what isn't a number last
            if m == self.k:
                held = np.where(self.empty[rows, -1], np.inf, self.distance[rows, -1])
                most = np.fmin(most, (held + 1e-9) ** 2 + slack)
            top = (np.sqrt(np.maximum(most, 0)) + 2e-9) ** 2 + slack
            i, j = np.nonzero(~(squares > top[:, None]))
            self._merge(a + i, names[j], np.round(np.sqrt(((x[i] - y[j]) ** 2).sum(1)), 9))

    def _merge(self, rows: np.ndarray, names: np.ndarray, distances: np.ndarray) -> None:
        if not len(rows):
            return
        own = np.unique(rows)
        row = np.concatenate((np.repeat(own, self.k), rows))
        name = np.concatenate((self.found[own].ravel(), names)).astype(str)
        distance = np.concatenate((self.distance[own].ravel(), distances))
        empty = np.concatenate((self.empty[own].ravel(), np.zeros(len(rows), bool)))
        order = np.lexsort((name, distance, empty, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        kept = order[place < self.k]
        self.found[own] = name[kept].reshape(len(own), self.k)
        self.distance[own] = distance[kept].reshape(len(own), self.k)
        self.empty[own] = empty[kept].reshape(len(own), self.k)

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(~self.empty)
        columns = [pa.array(self.names[i].tolist(), pa.string()), pa.array(self.found[i, j].tolist(), pa.string()), pa.array(self.distance[i, j], pa.float64()), pa.array(j + 1, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["concept_id", "neighbour_id", "distance", "rank"])


def neighbours(vectors: DataFrame, k: int, block: int = 2048, wide: int = 8) -> DataFrame:
    """(concept_id, neighbour_id, distance, rank) of every vector's k nearest, itself included; ties by id.

    Vectors are packed into blocks of about `block` rows. A task holds a wide block of `wide` times as many and lets all blocks pass by, one
    after the other: a matrix product gives distances, those that can be among the k nearest are measured exactly, and only the k nearest leave
    the task. Every block is sent once for each wide block, so bytes sent and products grow with the square of the rows, in
    bounded memory. Null vectors take no part; all are of one length.
    """
    rows = vectors.filter("embedding is not null").select("concept_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    blocks, wides = max(1, -(-n // block)), max(1, -(-n // (block * wide)))

    def packed(name: str, count: int) -> DataFrame:
        held = rows.groupBy(F.pmod(F.xxhash64("concept_id"), F.lit(count)).alias(name)).agg(F.collect_list(F.struct("concept_id", "embedding")).alias("_v"))
        return held.select(name, F.col("_v.concept_id").alias("ids"), F.flatten(F.col("_v.embedding")).alias("flat"))

    here = packed("task", wides).select("task", F.lit(-1).cast("long").alias("part"), "ids", "flat")
    passing = packed("part", blocks).select(F.explode(F.sequence(F.lit(0), F.lit(wides - 1)).cast("array<bigint>")).alias("task"), "part", "ids", "flat")
    sent = here.unionByName(passing).repartition(wides, "task").sortWithinPartitions("task", "part")

    def run(batches):
        now = task = None
        for batch in batches:
            for row in range(batch.num_rows):
                opens = batch.column(1)[row].as_py() < 0
                if not opens and batch.column(0)[row].as_py() != task:
                    continue  # a wide block without rows
                names = np.array(batch.column(2)[row].as_py(), dtype=object)
                x = batch.column(3)[row].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1)
                if opens:
                    if now is not None:
                        yield now.rows()
                    now, task = _Nearest(names, x, k), batch.column(0)[row].as_py()
                else:
                    now.offer(names, x)
        if now is not None:
            yield now.rows()

    return sent.select("task", "part", "ids", "flat").mapInArrow(run, "concept_id string, neighbour_id string, distance double, rank int")


def proximity_pairs(vectors: DataFrame, min_similarity: float = 0.70, top: int = 5) -> DataFrame:
    """(id_a, id_b, distance): each vector's top neighbours but itself, within the distance of min_similarity (inclusive)."""
    limit = math.sqrt(2 - 2 * min_similarity)
    near = neighbours(vectors, top + 1).filter((F.col("concept_id") != F.col("neighbour_id")) & (F.col("distance") <= limit))
    first = W.partitionBy("concept_id").orderBy("distance", "neighbour_id")
    near = near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= top)
    pair = near.select(F.least("concept_id", "neighbour_id").alias("id_a"), F.greatest("concept_id", "neighbour_id").alias("id_b"), "distance")
    return pair.groupBy("id_a", "id_b").agg(F.min("distance").alias("distance"))


def near_duplicates(question: list[float], filed: DataFrame, min_cosine: float = 0.93) -> DataFrame:
    """Filed questions (concept_id, similarity) at min_cosine or above, most similar first.

    All or nothing: if a filed item has no vector the result is one row with a null id and a null similarity.
    """
    from cairn.functions.expr import cosine

    q = F.array(*[F.lit(float(x)) for x in question])
    compared = filed.select("concept_id", F.when(F.col("embedding").isNotNull(), F.round(cosine(F.col("embedding"), q), 9)).alias("similarity"))
    missing = compared.filter("similarity is null").limit(1).select(F.lit(None).cast("string").alias("concept_id"), F.lit(None).cast("double").alias("similarity"))
    hits = compared.filter(F.col("similarity") >= min_cosine)
    flag = missing.select(F.lit(True).alias("_m"))
    hits = hits.join(F.broadcast(flag), how="left_anti", on=F.lit(True))  # flag is one row at most
    return hits.unionByName(missing).orderBy(F.desc("similarity"), "concept_id")


def upsert(store: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The store with rows of equal key replaced by the changes; the last of repeated changes by content wins."""
    latest = changes.dropDuplicates(key)
    return store.join(latest.select(*key), key, "left_anti").unionByName(latest)


def prune(store: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    return store.join(seen.select(*key).distinct(), key, "left_semi")

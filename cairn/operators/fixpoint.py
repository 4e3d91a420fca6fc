"""Fixpoints over provenance(child, parent): closures, ancestors, high-water marks.

Each round joins only what the last one added and writes only that; what was added so far is a list of
written parts, put together every few rounds. Parts are deleted when they are replaced.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.expr import combine, level_of, rank

MAX_ROUNDS = 10_000


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared folder and read back. Where none is set, a temporary folder serves a local master (tests)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_cairn_path", None):
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Parts:
    """A table that grows by rounds: the union of few written parts."""

    def __init__(self, first: DataFrame | None = None, most: int = 6):
        self.parts, self.most = [] if first is None else [first], most

    def add(self, part: DataFrame) -> None:
        """The newest part stays by itself: the next round reads it alone."""
        if len(self.parts) >= self.most:
            whole = cut(self.all())
            drop(*self.parts)
            self.parts = [whole]
        self.parts.append(part)

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)


def reachable(edges: DataFrame, roots: DataFrame, down: bool = True) -> DataFrame:
    """id of all that any path reaches from the roots, roots included; down follows parent to child. Safe on cycles."""
    here, there = ("parent", "child") if down else ("child", "parent")
    step = cut(edges.select(F.col(here).alias("id"), F.col(there).alias("next")).distinct())
    front = cut(roots.select("id").distinct())
    seen = Parts(front)
    for _ in range(MAX_ROUNDS):
        front = cut(front.join(step, "id").select(F.col("next").alias("id")).distinct().join(seen.all(), "id", "left_anti"))
        if front.isEmpty():
            drop(step, front)
            return seen.all()
        seen.add(front)
    raise RuntimeError("no fixpoint")


def closures(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(source, id) of each source's roots and of all whose parents, one at least, are every one in that source's set. roots: source, id.

    A document's parents are counted as they enter: it enters when as many have as it cites.
    """
    step = cut(edges.select("child", "parent").distinct())
    cites = cut(step.groupBy("child").agg(F.count(F.lit(1)).alias("cites")))
    front = cut(roots.select("source", "id").distinct())
    seen, hits = Parts(front), Parts()
    for _ in range(MAX_ROUNDS):
        new = cut(front.join(step, front.id == step.parent).groupBy("source", "child").agg(F.count(F.lit(1)).alias("hit")))
        if new.isEmpty():
            drop(step, cites, new, *hits.parts)
            return seen.all()
        hits.add(new)
        met = hits.all().join(new.select("source", "child"), ["source", "child"], "left_semi").groupBy("source", "child").agg(F.sum("hit").alias("met"))
        full = met.join(cites, "child").filter("met = cites").select("source", F.col("child").alias("id"))
        front = cut(full.join(seen.all(), ["source", "id"], "left_anti"))
        seen.add(front)
    raise RuntimeError("no fixpoint")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id of the roots and of all whose parents, one at least, are every one in the set."""
    return closures(edges, roots.select(F.lit(0).alias("source"), "id")).select("id")


def source_ancestors(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Ancestors under sources/, whether or not a file stands behind them."""
    return reachable(edges, roots, down=False).join(roots, "id", "left_anti").filter(F.col("id").startswith("sources/"))


def high_water(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """id, level of all after raising: what cites only known documents (and isn't a source) is at least as high as each of them.

    levels: id, level (0..2), is_source. Rounds go on until no level rises; each level rises twice at most.
    """
    step = edges.select("child", "parent").distinct()
    known = levels.select(F.col("id").alias("parent"))
    broken = step.join(known, "parent", "left_anti").select(F.col("child").alias("id")).distinct()
    open_ = levels.filter("not is_source").select("id").join(broken, "id", "left_anti")
    step = cut(step.join(open_, step.child == open_.id, "left_semi"))
    base = cut(levels.select("id", "level"))
    front, raised = cut(base.filter("level > 0")), None
    for _ in range(MAX_ROUNDS):
        up = step.join(front, step.parent == front.id).groupBy(F.col("child").alias("id")).agg(F.max("level").alias("level"))
        now = base if raised is None else base.union(raised.all())
        held = now.join(up.select("id"), "id", "left_semi").groupBy("id").agg(F.max("level").alias("held"))
        risen = cut(up.join(held, "id").filter("level > held").select("id", "level"))
        if risen.isEmpty():
            drop(step, risen)
            return now.groupBy("id").agg(F.max("level").alias("level"))
        if raised is None:
            raised = Parts(risen)
        else:
            raised.add(risen)
        front = risen
    raise RuntimeError("no fixpoint")


def unresolved(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(child, parent) of citations that no document answers."""
    return edges.select("child", "parent").distinct().join(ids.select(F.col("id").alias("parent")), "parent", "left_anti").select("child", "parent")


def best_raises(raises: DataFrame) -> DataFrame:
    """id, level, producer: the highest raise of each document; of equals the first producer's."""
    order = F.struct(F.col("level"), (-F.col("priority")).alias("p"))
    return raises.groupBy("id").agg(F.max("level").alias("level"), F.max_by("producer", order).alias("producer"))


def _raises(found: DataFrame) -> DataFrame:
    """Those whose new level is spelled otherwise than the current one: a missing or unknown level is written out too."""
    return found.filter(~F.col("new_level").eqNullSafe(F.col("current")))


def source_raises(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(source, id, current, new_level) of each source's descendants that its level raises. docs: id, type, sensitivity."""
    sources = docs.filter("type = 'Source'").select(F.col("id").alias("source"), F.col("sensitivity").alias("_of"))
    covered = closures(edges, sources.select("source", F.col("source").alias("id"))).filter("source <> id")
    held = covered.join(sources, "source").join(docs.select("id", F.col("sensitivity").alias("current")), "id")
    return _raises(held.select("source", "id", "current", combine(F.col("current"), F.col("_of")).alias("new_level")))


def cited_raises(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, current, new_level) of documents that aren't sources, cite only known documents and are raised to the highest of these."""
    known = docs.select(F.col("id").alias("parent"), F.lit(True).alias("_k"))
    cites = edges.select("child", "parent").distinct().join(known, "parent", "left").groupBy("child").agg(F.count_if(F.col("_k").isNull()).alias("_gone")).filter("_gone = 0")
    levels = docs.select("id", rank(F.col("sensitivity")).alias("level"), F.coalesce(F.col("type") == "Source", F.lit(False)).alias("is_source"))
    high = high_water(edges, levels).select("id", F.col("level").alias("_high"))
    own = docs.filter("coalesce(type, '') <> 'Source'").join(cites.select(F.col("child").alias("id")), "id", "left_semi").select("id", F.col("sensitivity").alias("current"))
    return _raises(own.join(high, "id").select("id", "current", level_of(F.greatest(rank(F.col("current")), F.col("_high"))).alias("new_level")))


def backfill_raises(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, current, new_level, producer): each document's highest raise, by a source (the first of equals by id) or, where that is higher,
    'cited'."""
    by_source = source_raises(edges, docs).select("id", "current", "new_level", F.lit(0).alias("turn"), "source", F.col("source").cast("string").alias("producer"))
    cited = cited_raises(edges, docs).select("id", "current", "new_level", F.lit(1).alias("turn"), F.lit(None).cast(by_source.schema["source"].dataType).alias("source"), F.lit("cited").alias("producer"))
    place = F.row_number().over(W.partitionBy("id").orderBy(rank(F.col("new_level")).desc(), "turn", "source"))
    return by_source.unionByName(cited).withColumn("_n", place).filter("_n = 1").drop("_n", "turn", "source")

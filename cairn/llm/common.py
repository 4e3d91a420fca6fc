"""Helpers that several operators share: input, shared-folder tables, word hashing."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary one if the master is local (tests), or else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Spark then deletes a query's shuffle files when it ends, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives executor loss, frees its shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing reads any more."""
    path = getattr(df, "_cairn_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_digest(df: DataFrame) -> Column:
    """A 64-bit digest of all plain columns, used only to break ties between rows."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every word of the texts, and where each text's words begin (n + 1 offsets).

    Words are maximal runs without ASCII white space; A-Z are lower-cased. A word's
    hash is a polynomial over random byte values modulo 2**64, finalised by mix().
    """
    texts = [t or b"" for t in texts]
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = _LOWER[raw] if lower else raw
    solid = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    starts = np.flatnonzero(solid & (first[:-1] | np.concatenate(([True], ~solid[:-1]))))
    ends = np.flatnonzero(solid & (first[1:] | np.concatenate((~solid[1:], [True])))) + 1
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)))
        value = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    return mix(value), np.searchsorted(starts, edges)


def text_blocks(column: pa.Array, limit: int = 1 << 22):
    """(first, last, texts as bytes) over slices of an Arrow string column of about limit bytes each."""
    column = column.cast(pa.large_binary())
    n, at = len(column), 0
    while at < n:
        held, size, begin = [], 0, at
        while at < n and (not held or size < limit):
            held.append(column[at].as_py() or b"")
            size += len(held[-1])
            at += 1
        yield begin, at, held


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run):
    """A function over a task's Arrow batches that gives freed memory back to the system when its task ends: workers live on, and the stages
    after need the memory for other things."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def few_at_a_time(batches, column: int = 1, limit: int = 1 << 22):
    """The batches in slices of about `limit` bytes of that text column, one row at least: what is made of a slice is as small."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = np.cumsum(sizes) // limit
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now rather than at the next collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()

"""Near duplicates by an exact Jaccard join over word shingles, with PartEnum signatures.

Sets are banded by size (each band's largest size is 1/threshold of its smallest), so
linked sets stand in one band or in neighbouring ones; an instance serves a band and
the next. Linked sets of an instance differ in at most k elements. The element domain is cut into n1
first-level parts, each into n2 second-level ones. With n1 > k / (k2 + 1), linked sets differ in at most k2 elements of some
first-level part, so they are equal on some n2 - k2 of its second-level parts: every such subset of every first-level
part gives a signature (the set's elements there). n1, n2 and k2 are chosen by band for few signatures with
enough elements each. `spare` more first-level parts leave spare + 1 of that kind; so empty
subsets need signatures only in sets with empty subsets in more than `spare` first-level parts.

Sets that share a signature are compared with the group's first member, then, across components that are still
apart, with some members of the group's commonest component, and at last with all members
that sketches don't rule out: components come out exactly as if
all pairs had been compared, without pairs inside what is already joined.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, materialize, mix, release, text_blocks, tidy, word_hashes

WIDTH = 5
_M = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
SKETCH_WORDS = 8
WIDE_FROM = 800


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; of fewer words, one of them all; of none, none."""
    words, at = word_hashes(texts)
    out = []
    n = len(words)
    with np.errstate(over="ignore"):
        wide = np.zeros(max(n - width + 1, 0), np.uint64)
        for j in range(width):
            wide += words[j : j + len(wide)] * _M[j]
        wide = mix(wide)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                x = np.sort(wide[a : b - width + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            elif b > a:
                out.append(mix((words[a:b] * _M[8 : 8 + b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(x: np.ndarray) -> int:
    """A 64-bit digest of a set; never 0 for one with elements."""
    with np.errstate(over="ignore"):
        total = mix(x ^ _M[20]).sum(dtype=np.uint64, keepdims=True)
        return int(mix(total + np.uint64(len(x)) * _M[21])[0] | np.uint64(1)) if len(x) else 0


def sketch(x: np.ndarray) -> np.ndarray:
    """Parities of how many elements fall on each bit; two sketches differ in no more bits than the sets in elements."""
    bit = mix(x ^ _M[22]) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def wide_sketch(x: np.ndarray) -> bytes:
    """The same over as many bits as the set has elements or up to twice that, for sets that fill the small one; empty for others."""
    if len(x) <= WIDE_FROM:
        return b""
    bits = 1 << (len(x) - 1).bit_length()
    odd = np.bincount((mix(x ^ _M[27]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_differ(a: bytes, b: bytes) -> int:
    """In how many bits two wide sketches differ; the longer one is folded, which leaves parities over fewer bits."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


class Bands:
    """Sizes to instances (n1, n2, k2, spare) for links at 100 * intersection >= percent * union."""

    def __init__(self, percent: int = 80):
        self.percent = percent
        self.low: list[int] = [1]
        self.high: list[int] = [100 // percent]
        self._known: dict[int, tuple[int, int, int, int]] = {}

    def band(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], self.low[-1] * 100 // self.percent))
        return int(np.searchsorted(self.high, size))

    def differ(self, j: int) -> int:
        """In how many elements linked sets differ at most, one of band j, the other of this or the next."""
        top = self.high[j]
        return (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def instance(self, j: int) -> tuple[int, int, int, int]:
        """The parameters of the instance that serves band j and the next: the cheapest ones."""
        if j not in self._known:
            k = self.differ(j)
            choices = [(k // (k2 + 1) + 1, n2, k2) for k2 in range(4) for n2 in range(k2 + 1, k2 + 5) if k2 or n2 == 1]
            whole = [(n1 + spare, n2, k2, spare) for n1, n2, k2 in choices for spare in ((0, n1 // 12 + 3) if k else (0,))]
            self._known[j] = min(whole, key=lambda c: (self._cost(self.low[j], *c), c))
        return self._known[j]

    @staticmethod
    def _cost(size: int, n1: int, n2: int, k2: int, spare: int) -> float:
        """Signatures, weighed by how few elements the smallest sets have in one, and by how many of these sets have empty ones to send."""
        held = size / n1 * (n2 - k2) / n2
        empty = n1 * min(1.0, comb(n2, k2) * exp(-held))
        sends, term = 1.0, exp(-empty)
        for i in range(spare + 1):
            sends -= term
            term *= empty / (i + 1)
        return n1 * comb(n2, k2) * (1 + 20 * exp(-held)) + 1000 * max(sends, 0.0)


def signatures(x: np.ndarray, bands: Bands) -> np.ndarray:
    """The set's signatures, each in the instance of its own band and of the band before."""
    if not len(x):
        return np.zeros(0, np.uint64)
    band = bands.band(len(x))
    value = mix(x ^ _M[23])
    out = []
    with np.errstate(over="ignore"):
        term = x * _M[24]
        for j in (band, band - 1):
            if j < 0:
                continue
            n1, n2, k2, spare = bands.instance(j)
            part = (((value >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)
            size = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
            order = np.argsort(part, kind="stable")
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term[order], dtype=np.uint64)))
            edges = np.concatenate(([0], np.cumsum(size.ravel())))
            held = (total[edges[1:]] - total[edges[:-1]]).reshape(n1, n2)
            subsets = list(combinations(range(n2), n2 - k2))
            sums = np.stack([held[:, s].sum(1, dtype=np.uint64) for s in subsets], 1)
            empty = np.stack([size[:, s].sum(1) == 0 for s in subsets], 1)
            tag = mix(np.arange(n1 * len(subsets), dtype=np.uint64).reshape(n1, -1) + np.uint64(j + 1) * _M[25])
            keep = ~empty if empty.any(1).sum() <= spare else np.ones_like(empty)
            out.append(mix(sums + tag)[keep])
    return np.concatenate(out)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp, s0.. of every row."""

    def run(batches):
        for batch in batches:
            n, fp, sk, wide = [], [], [], []
            for _, _, held in text_blocks(batch.column(1)):
                for x in shingle_sets(held):
                    n.append(len(x))
                    fp.append(fingerprint(x))
                    sk.append(sketch(x))
                    wide.append(wide_sketch(x))
            sk = np.array(sk, np.uint64).reshape(-1, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _signed(np.array(fp, np.uint64)), *[_signed(sk[:, i]) for i in range(SKETCH_WORDS)], pa.array(wide, pa.binary())], ["doc_id", "n_shingles", "fp", *[f"s{i}" for i in range(SKETCH_WORDS)], "wide"])

    schema = "doc_id long, n_shingles long, fp long, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS)) + ", wide binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema)


def _signature_rows(docs: DataFrame, percent: int) -> DataFrame:
    """sig, fp; sets met before in the same task give nothing again."""

    def run(batches):
        bands, seen = Bands(percent), set()
        for batch in batches:
            for _, _, held in text_blocks(batch.column(0)):
                sigs, fps = [], []
                for x in shingle_sets(held):
                    fp = fingerprint(x)
                    if fp and fp not in seen:
                        seen.add(fp)
                        s = signatures(x, bands)
                        sigs.append(s)
                        fps.append(np.full(len(s), fp, np.uint64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(sigs)), _signed(np.concatenate(fps))], ["sig", "fp"])

    return docs.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(tidy(run), "sig long, fp long")


def _shared(rows: DataFrame) -> DataFrame:
    """sig, fp, leader of the signatures that two different sets or more have; leader: the smallest fp."""

    def run(batches):
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if not held:
            return
        sig, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((fp, sig))
        sig, fp = sig[order], fp[order]
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])))
        sig, fp = sig[fresh], fp[fresh]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        sizes = np.diff(np.append(first, len(sig)))
        keep = np.repeat(sizes > 1, sizes)
        leader = np.repeat(fp[first], sizes)
        out = [x[keep] for x in (sig, fp, leader)]
        for i in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], pa.int64()) for x in out], ["sig", "fp", "leader"])

    return rows.repartition("sig").mapInArrow(tidy(run), "sig long, fp long, leader long")


def _by_signature(batches, width: int):
    """A task's rows (sig, fp, root, ...) sorted by (sig, root), and of each signature whose sets stand in two components or more:
    where its rows begin and end, and home, the commonest root (the smallest of equals)."""
    held = [tuple(np.asarray(b.column(i)) for i in range(width)) for b in batches]
    if not sum(len(h[0]) for h in held):
        return [], []
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    order = np.lexsort((columns[2], columns[0]))
    columns = [c[order] for c in columns]
    sig, root = columns[0], columns[2]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    last = np.append(first[1:], len(sig))
    run_at = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (root[1:] != root[:-1]))))
    run_size = np.diff(np.append(run_at, len(sig)))
    group = np.searchsorted(first, run_at, "right") - 1
    best = np.lexsort((root[run_at], -run_size, group))
    home = root[run_at][best[np.concatenate(([True], group[best][1:] != group[best][:-1]))]]
    mixed = root[first] != root[last - 1]
    return columns, list(zip(first[mixed].tolist(), last[mixed].tolist(), home[mixed].tolist(), strict=True))


def _yield_rows(columns: list[np.ndarray], names: list[str], step: int = 100_000):
    for i in range(0, len(columns[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + step], pa.int64()) for x in columns], names)


def _some(rows: DataFrame, picks: int = 2) -> DataFrame:
    """a, b: each set that isn't of its signature's commonest component, with `picks` members of that, by hash."""

    def run(batches):
        columns, groups = _by_signature(batches, 3)
        if not groups:
            return
        sig, fp, root = columns
        left, right = [], []
        for first, last, home in groups:
            here = root[first:last] == home
            apart, members = fp[first:last][~here], fp[first:last][here]
            for i in range(picks):
                with np.errstate(over="ignore"):
                    pick = mix(apart.view(np.uint64) ^ mix(sig[first : first + 1].view(np.uint64) + np.uint64(i)))
                left.append(apart)
                right.append(members[(pick % np.uint64(len(members))).astype(np.int64)])
        pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right))), axis=1)
        yield from _yield_rows(list(pairs), ["a", "b"])

    return rows.select("sig", "fp", "root").repartition("sig").mapInArrow(tidy(run), "a long, b long").distinct()


def _apart(rows: DataFrame) -> DataFrame:
    """sig, fp, root of the signatures whose sets stand in two components or more."""

    def run(batches):
        columns, groups = _by_signature(batches, 3)
        if groups:
            keep = np.concatenate([np.arange(a, b) for a, b, _ in groups])
            yield from _yield_rows([c[keep] for c in columns], ["sig", "fp", "root"])

    return rows.select("sig", "fp", "root").repartition("sig").mapInArrow(tidy(run), "sig long, fp long, root long")


def _across(rows: DataFrame, percent: int, block: int = 1 << 20) -> DataFrame:
    """a, bs: each set that isn't of its signature's commonest component, with the sets of other components that sizes and
    sketches don't rule out. A task tells a pair once, however many signatures it shares there; blocks bound its memory."""
    names = ["sig", "fp", "root", "n_shingles", *[f"s{i}" for i in range(SKETCH_WORDS)]]

    def told(pairs: list[np.ndarray]):
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), pa.array(b, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(a[first], pa.int64()), lists], ["a", "bs"])

    def run(batches):
        columns, groups = _by_signature(batches, len(names))
        found, size = [np.zeros((2, 0), np.int64)], 0
        for first, last, home in groups:
            fp, root, n = (c[first:last] for c in columns[1:4])
            sketches = np.stack([c[first:last] for c in columns[4:]], 1).view(np.uint64)
            apart = np.flatnonzero(root != home)
            for i in range(0, len(apart), step := max(1, block // (8 * len(fp)))):
                x = apart[i : i + step]
                ok = (root[x, None] != root) & ((root == home) | (fp[x, None] < fp))
                ok &= 100 * np.minimum(n[x, None], n) >= percent * np.maximum(n[x, None], n)
                p, q = np.nonzero(ok)
                differ = np.bitwise_count(sketches[x[p]] ^ sketches[q]).sum(1, dtype=np.int64)
                hit = (100 + percent) * differ <= (100 - percent) * (n[x[p]] + n[q])
                found.append(np.stack((fp[x[p[hit]]], fp[q[hit]])))
                size += len(found[-1][0])
                if size > block:
                    found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                    size = len(found[0][0])
                    if size > block // 2:
                        yield told(found)
                        found, size = [np.zeros((2, 0), np.int64)], 0
        yield told(found)

    return rows.select(*names).repartition("sig").mapInArrow(tidy(run), "a long, bs array<long>")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches don't rule out, with rep_a and rep_b; rules out none that link."""
    names = ["fp", "rep", "n_shingles", *[f"s{i}" for i in range(SKETCH_WORDS)]]
    left = nodes.select(*[F.col(c).alias("a" if c == "fp" else f"a_{c}") for c in names])
    right = nodes.select(*[F.col(c).alias("b" if c == "fp" else f"b_{c}") for c in names])
    return pairs.join(left, "a").join(right, "b").filter(_possible("a_", "b_", percent)).select("a", "b", F.col("a_rep").alias("rep_a"), F.col("b_rep").alias("rep_b"))


def _possible(a: str, b: str, percent: int):
    n_a, n_b = F.col(f"{a}n_shingles"), F.col(f"{b}n_shingles")
    differ = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * differ <= (100 - percent) * (n_a + n_b))


def _still_likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that wide sketches don't rule out either; pairs of small sets pass."""
    names = pairs.columns
    side = lambda k: nodes.filter(F.length("wide") > 0).select(F.col("fp").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("wide").alias(f"w_{k}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(*names, "n_a", "n_b", "w_a", "w_b")

    def run(batches):
        for batch in batches:
            keep = [
                i
                for i, (n, m, x, y) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(len(names), len(names) + 4)), strict=True))
                if x is None or y is None or (100 + percent) * wide_differ(x, y) <= (100 - percent) * (n + m)
            ]
            yield batch.select(names).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(tidy(run), pairs.schema)


def _verify(pairs: DataFrame, docs: DataFrame, percent: int, most: int = 256) -> DataFrame:
    """rep_a, rep_b of the pairs (a, b, rep_a, rep_b) that link. A set with many partners is sent in salted copies."""

    def sets(batches):
        for batch in batches:
            out = [x for _, _, held in text_blocks(batch.column(0)) for x in shingle_sets(held)]
            yield pa.RecordBatch.from_arrays([_signed(np.array([fingerprint(x) for x in out], np.uint64)), pa.array([x.tobytes() for x in out], pa.binary())], ["fp", "held"])

    need = materialize(pairs.select(F.col("rep_a").alias("doc_id")).union(pairs.select("rep_b")).distinct())
    held = docs.select(F.col("doc_id").cast("long"), "text").join(need, "doc_id").select("text").mapInArrow(tidy(sets), "fp long, held binary")
    held = materialize(held.dropDuplicates(["fp"]))
    counts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / most) + 1).cast("int").alias("copies"))
    firsts = counts.join(held.withColumnRenamed("fp", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rep_a"), F.lit(None).cast("long").alias("rep_b"), "held")
    members = (
        pairs.join(counts, "a")
        .join(held.withColumnRenamed("fp", "b"), "b")
        .select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("kind"), "rep_a", "rep_b", "held")
    )

    def compare(batches):
        now, mine = None, None
        for batch in batches:
            a, salt, kind, rep_a, rep_b, data = (batch.column(i).to_pylist() for i in range(6))
            left, right = [], []
            for i in range(len(a)):
                x = np.frombuffer(data[i], np.uint64)
                if kind[i] == 0:
                    now, mine = (a[i], salt[i]), x
                elif (a[i], salt[i]) == now:
                    both = len(x) + len(mine) - len(np.union1d(x, mine))
                    if 100 * both >= percent * (len(x) + len(mine) - both):
                        left.append(rep_a[i])
                        right.append(rep_b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["rep_a", "rep_b"])

    rows = firsts.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    out = materialize(rows.mapInArrow(tidy(compare), "rep_a long, rep_b long").distinct())
    discard(held)
    discard(need)
    return out


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, root of every node of the edges; root: the smallest node it is joined with. Large and small stars in turn."""
    now = materialize(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u <> v").distinct()
        after = materialize(small)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if state == mark:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._cairn_path = now._cairn_path
            return out
        mark = state


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of five-word
    shingles (A-Z lower-cased; with fewer words the whole sequence is one shingle). component_id
    is the smallest doc_id that links reach. A text without words, or null, links with nothing, not even its like.
    Very long texts are taken whole; all ties are links. doc_id is taken as a key: of rows that share it each gets the component of its own text. Rows with a
    null doc_id link with nothing and have a null component_id. Sets are told apart by 64-bit digests. Other columns are ignored.
    """
    spark = docs.sparkSession
    sketches = [f"s{i}" for i in range(SKETCH_WORDS)]
    scanned = materialize(_scan(docs))
    nodes = materialize(scanned.filter("fp <> 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", *sketches, "wide")]))
    groups = materialize(_shared(_signature_rows(docs, percent)))
    release(spark)
    links: list[DataFrame] = []
    roots: DataFrame | None = None

    def classes(*columns: str) -> DataFrame:
        if roots is None:
            return nodes.select("fp", F.col("rep").alias("root"), *columns)
        return nodes.join(roots, nodes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("root"), *columns)

    def linked(pairs: DataFrame) -> None:
        """Compares the pairs (a, b) that sketches don't rule out, and joins components by those that link."""
        nonlocal roots
        pairs = materialize(_still_likely(_likely(pairs, nodes, percent), nodes, percent))
        if not pairs.isEmpty():
            more = _verify(pairs, docs, percent)
            if more.isEmpty():
                discard(more)
            else:
                links.append(more)
                edges = links[0]
                for x in links[1:]:
                    edges = edges.unionByName(x)
                before, roots = roots, components(edges, "rep_a", "rep_b")
                if before is not None:
                    discard(before)
        discard(pairs)
        release(spark)

    linked(groups.filter("fp <> leader").select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct())
    linked(_some(groups.select("sig", "fp").join(classes(), "fp")))
    open_rows = materialize(_apart(groups.select("sig", "fp").join(classes(), "fp")))
    discard(groups)
    known = open_rows.join(nodes.select("fp", "n_shingles", *sketches), "fp")
    pairs = _across(known, percent).groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs"))
    linked(pairs.select("a", F.explode("bs").alias("b")))
    discard(open_rows)
    out = scanned.select("doc_id", "n_shingles", "fp").join(classes(), "fp", "left")
    out = materialize(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id")))
    for t in (scanned, nodes, *links, *([roots] if roots is not None else [])):
        discard(t)
    release(spark)
    return out


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest doc_id.

    Texts without words are no duplicates and stay, as do rows with a null doc_id; of rows that share a doc_id one stays.
    """
    found = near_duplicates(docs, percent)
    stay = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.filter(F.col("doc_id").isNotNull()).join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(F.col("doc_id").isNull()))

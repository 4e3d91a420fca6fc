"""Exact top-k inner products by dual-tree search over cover trees.

The top two levels of the tree are bounded sets of centres; a cell that holds more than a block's
rows is cut into blocks, each with a cover tree of its own. Queries are grouped by the
same centres and form trees too. A pair of nodes is dropped when no inner product
between them can reach the query node's worst kth score: the centres' product plus
what the covering radii allow. Scores are whole numbers, worked out exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import materialize, tidy

LOW = np.iinfo(np.int64).min


def quantise(vector, scale: float = 64.0) -> np.ndarray | None:
    """floor(scale * x) of each component as a double, which holds it exactly; None for null or non-finite ones."""
    if vector is None or not len(vector):
        return None
    x = np.array([np.nan if v is None else v for v in vector], np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
    return x if np.isfinite(x).all() else None


def quantised(column: pa.Array, scale: float = 64.0) -> list[np.ndarray | None]:
    """quantise() of every row of a column of lists of doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    edges = lists.offsets.to_numpy()
    here = lists.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok and b > a and bad[a] == bad[b] else None for a, b, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), here.tolist(), strict=True)]


def pack(x: np.ndarray) -> bytes:
    """Two bytes a component where they fit, or else eight."""
    return x.astype(np.int16).tobytes() if np.abs(x).max(initial=0) < 32_768 else x.tobytes()


def unpack(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * dim else np.float64).astype(np.float64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; beyond its range they end at its limits."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if top < 2**24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = [[int(v) for v in r] for r in x]
    out = np.empty((len(q), len(x)), np.int64)
    for i, r in enumerate(q):
        r = [int(v) for v in r]
        for j, c in enumerate(whole):
            out[i, j] = min(max(sum(a * b for a, b in zip(r, c, strict=True)), LOW + 1), np.iinfo(np.int64).max)
    return out


class Node:
    __slots__ = ("centre", "radius", "rows", "children", "norm")

    def __init__(self, centre, radius, rows):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, []
        self.norm = float(np.linalg.norm(centre))


def build(x: np.ndarray, leaf: int, fan: int = 8) -> Node:
    """A cover tree: children are chosen farthest first until they cover their node at half its radius, fan of them at most.

    Where fan children don't get below four fifths of the radius (unclustered rows in many dimensions) a node stays a leaf:
    its parts would prune nothing that it doesn't, and one product of matrices is cheaper than many small ones.
    """

    def node(rows: np.ndarray, centre: np.ndarray) -> Node:
        away = np.linalg.norm(x[rows] - centre, axis=1)
        out = Node(centre, float(away.max()), rows)
        if len(rows) <= leaf or out.radius == 0:
            return out
        near, owner = away, np.zeros(len(rows), np.int64)
        centres = [centre]
        while len(centres) < fan and near.max() > out.radius / 2:
            centres.append(x[rows[int(near.argmax())]])
            d = np.linalg.norm(x[rows] - centres[-1], axis=1)
            owner = np.where(d < near, len(centres) - 1, owner)
            near = np.minimum(near, d)
        if len(centres) > 1 and near.max() <= 0.8 * out.radius:
            parts = [rows[owner == i] for i in range(len(centres))]
            out.children = [node(p, c) for p, c in zip(parts, centres, strict=True) if len(p)]
        return out

    return node(np.arange(len(x)), x.mean(0))


def reach(a: Node, b: Node) -> float:
    """No inner product between the two nodes exceeds this."""
    most = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    return most + 1e-9 * abs(most) + 1e-6


class Best:
    """The k best of each query so far: scores descending, then ids ascending."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.scores = np.full((len(ids), k), LOW, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.floor = np.full(len(ids), LOW, np.int64) if floor is None else floor

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merges all rows' hits in one sort; a row offers what reaches its worst kth score and its own kth of these."""
        scores = np.where(self.ids[rows][:, None] == ids[None, :], LOW, scores)
        need = self.worst(rows)
        open_ = np.flatnonzero(scores.max(1, initial=LOW) >= np.maximum(need, LOW + 1))
        if not len(open_):
            return
        rows, scores, need = rows[open_], scores[open_], need[open_]
        if scores.shape[1] > self.k:
            need = np.maximum(need, np.partition(scores, -self.k, axis=1)[:, -self.k])
        at, column = np.nonzero((scores >= need[:, None]) & (scores > LOW))
        owner = np.concatenate((np.repeat(np.arange(len(rows)), self.k), at))
        value = np.concatenate((self.scores[rows].ravel(), scores[at, column]))
        found = np.concatenate((self.found[rows].ravel(), ids[column]))
        order = np.lexsort((found, ~value, owner))  # ~value falls as value rises, without overflow
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        first = order[place < self.k]
        self.scores[rows], self.found[rows] = value[first].reshape(len(rows), self.k), found[first].reshape(len(rows), self.k)


def dual_search(queries: np.ndarray, q_tree: Node, data: np.ndarray, ids: np.ndarray, d_tree: Node, best: Best) -> int:
    """Offers every pair of rows that can matter to best; returns how many products it worked out."""
    done, stack = 0, [(q_tree, d_tree)]
    while stack:
        a, b = stack.pop()
        if reach(a, b) < best.worst(a.rows).min():
            continue
        if not a.children and not b.children:
            best.offer(a.rows, ids[b.rows], products(queries[a.rows], data[b.rows]))
            done += len(a.rows) * len(b.rows)
        elif b.children and (not a.children or len(b.rows) >= len(a.rows)):
            stack += sorted(((a, c) for c in b.children), key=lambda p: reach(*p))
        else:
            stack += [(c, b) for c in a.children]
    return done


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.stack([unpack(b, dim) for b in blobs]) if blobs else np.zeros((0, dim))


def _search(rows: DataFrame, k: int, leaf: int) -> DataFrame:
    """rows: block, kind (0 data, 1 queries), dim, vec_id, chunk, ids, packs, floor; holds one block and one chunk at a time."""

    def run(batches):
        state: dict = {"block": None, "ids": [], "packs": [], "tree": None}
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for block, kind, dim, chunk, ids, packs, floor in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if block != state["block"]:
                    state = {"block": block, "ids": [], "packs": [], "tree": None}
                if kind == 0:
                    state["ids"] += ids
                    state["packs"] += packs
                    continue
                if not state["ids"]:  # a home block without data: the queries go on to the other blocks
                    for column, y in zip(out, ([chunk] * len(ids), [dim] * len(ids), ids, packs, [[]] * len(ids), [[]] * len(ids)), strict=True):
                        column += y
                    continue
                if state["tree"] is None:
                    unlike = sorted(set(zip(state["ids"], state["packs"], strict=True)))
                    state["v"] = np.array([u[0] for u in unlike], np.int64)
                    state["x"] = _matrix([u[1] for u in unlike], dim)
                    state["tree"] = build(state["x"], leaf)
                q = _matrix(packs, dim)
                best = Best(np.array(ids, np.int64), k, np.array(floor, np.int64))
                dual_search(q, build(q, 64), state["x"], state["v"], state["tree"], best)
                for i, v in enumerate(ids):
                    got = best.scores[i] > LOW
                    out[0].append(chunk)
                    out[1].append(dim)
                    out[2].append(v)
                    out[3].append(packs[i])
                    out[4].append(best.found[i][got].tolist())
                    out[5].append(best.scores[i][got].tolist())
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["chunk", "dim", "query_id", "packed", "ids", "scores"])

    wanted = rows.repartition("block").sortWithinPartitions("block", "kind").select("block", "kind", "dim", "chunk", "ids", "packs", "floor")
    return wanted.mapInArrow(tidy(run), "chunk long, dim int, query_id long, packed binary, ids array<long>, scores array<long>")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, block_rows: int = 4096, chunk_rows: int = 256, max_cells: int = 256, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row with all other rows.

    vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by `every`; candidates all
    rows but those with the query's own vec_id. Ties go to the smaller vec_id. Components count as
    floor(64 x); vectors that are null, empty or hold a null or non-finite component, and rows
    without a vec_id, take no part. Vectors of other lengths than the query's aren't candidates. Rows alike in
    vec_id and vector count once. Fewer than k candidates are all returned; no rows give no rows.
    The centres are fitted on about `sample` rows, 2 * sample at most; every row is indexed and the result is exact.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    total = rows.count()
    thin = F.pmod(F.xxhash64("vec_id"), F.lit(-(-max(total, 1) // sample))) == 0
    known = [q for r in rows.filter(thin).limit(2 * sample).collect() if (q := quantise(r[1])) is not None]
    dim = max({len(q) for q in known}, key=lambda d: (sum(len(q) == d for q in known), d), default=0)
    tops, subs, first_of = _two_levels(np.stack([q for q in known if len(q) == dim]) if known else np.zeros((1, 1)), -(-total // block_rows), max_cells)

    def cells(batches):
        for batch in batches:
            vectors = quantised(batch.column(1))
            kept = [i for i, q in enumerate(vectors) if q is not None]
            cell, away = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            same = [i for i in kept if len(vectors[i]) == dim]
            if same:
                x = np.stack([vectors[i] for i in same])
                top = _nearest(x, tops)
                near = np.empty(len(x), np.int64)
                for t in np.unique(top):
                    here = np.flatnonzero(top == t)
                    near[here] = first_of[t] + _nearest(x[here], subs[first_of[t] : first_of[t + 1]])
                cell[same], away[same] = near, np.linalg.norm(x - subs[near], axis=1)
            for i in kept:
                if len(vectors[i]) != dim:
                    away[i] = np.linalg.norm(vectors[i])
            packs = [pack(vectors[i]) for i in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(vectors[i]) for i in kept], pa.int32()), pa.array(cell[kept], pa.int32()), pa.array(away[kept], pa.float64()), batch.column(0).take(pa.array(kept, pa.int64())), pa.array(packs, pa.binary())],
                ["dim", "cell", "away", "vec_id", "packed"],
            )

    placed = materialize(rows.mapInArrow(tidy(cells), "dim int, cell int, away double, vec_id long, packed binary"))
    is_query = F.col("vec_id") % every == 0
    sizes = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("n_q"), F.max("away").alias("radius")).orderBy("dim", "cell").collect()
    layout, blocks, chunks = [], 0, 0
    for r in sizes:  # at most max_cells ** 1.5 rows for each vector length
        n, m = -(-r["n"] // block_rows), -(-max(r["n_q"], 1) // chunk_rows)
        layout.append((r["dim"], r["cell"], blocks, n, chunks, m, r["radius"]))
        blocks, chunks = blocks + n, chunks + m
    if not layout:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    plan = spark.createDataFrame([x[:6] for x in layout], "dim int, cell int, block0 long, blocks long, chunk0 long, chunks long")
    located = placed.join(plan, ["dim", "cell"])
    data = located.withColumn("block", F.col("block0") + F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    held = F.struct("vec_id", "packed")
    salt = F.pmod(F.xxhash64("vec_id", "packed"), F.lit(64))
    packed = data.groupBy("block", "dim", salt.alias("salt")).agg(F.collect_set(held).alias("held"))
    none = F.lit(None).cast("array<long>")
    data_rows = packed.select("block", F.lit(0).alias("kind"), "dim", F.lit(0).cast("long").alias("chunk"), F.col("held.vec_id").alias("ids"), F.col("held.packed").alias("packs"), none.alias("floor"))
    asked = located.filter(is_query).withColumn("chunk", F.col("chunk0") + F.pmod(F.xxhash64("vec_id"), F.col("chunks")))
    asked = asked.groupBy("dim", "cell", "block0", "chunk").agg(F.collect_set(held).alias("held"))
    lowest = F.transform("held", lambda x: F.lit(int(LOW)))
    homes = asked.select(F.col("block0").alias("block"), F.lit(1).alias("kind"), "dim", "chunk", F.col("held.vec_id").alias("ids"), F.col("held.packed").alias("packs"), lowest.alias("floor"))
    near = materialize(_search(data_rows.join(homes.select("block").distinct(), "block", "left_semi").unionByName(homes), k, leaf=512))

    chunk_starts = np.array([x[4] for x in layout])
    home_block = [x[2] for x in layout]
    spread = {}
    for d in {x[0] for x in layout}:
        own = [x for x in layout if x[0] == d]
        middle = np.stack([subs[x[1]] if d == dim else np.zeros(d) for x in own])
        spread[d] = (middle, np.array([x[6] for x in own]), [(x[2], x[2] + x[3]) for x in own])

    def visit(batches):
        """The chunk with the queries whose worst kth score a cell can reach, for each of its blocks but the home block."""
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for chunk, d, ids, packs, floor in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                q, least = _matrix(packs, d), np.array(floor, np.int64)
                middle, radius, blocks_of = spread[d]
                most = q @ middle.T + np.linalg.norm(q, axis=1)[:, None] * radius
                reached = most + 1e-9 * abs(most) + 1e-6 >= least[:, None]
                home = home_block[int(np.searchsorted(chunk_starts, chunk, "right")) - 1]
                for j in np.flatnonzero(reached.any(0)):
                    hit = np.flatnonzero(reached[:, j])
                    for block in range(*blocks_of[j]):
                        if block != home:
                            for column, y in zip(out, (block, 1, d, chunk, [ids[i] for i in hit], [packs[i] for i in hit], least[hit].tolist()), strict=True):
                                column.append(y)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["block", "kind", "dim", "chunk", "ids", "packs", "floor"])

    kth = F.when(F.size("scores") >= k, F.element_at("scores", -1)).otherwise(F.lit(int(LOW)))
    again = near.select("chunk", "dim", F.struct("query_id", "packed", kth.alias("floor")).alias("held")).groupBy("chunk", "dim").agg(F.collect_list("held").alias("held"))
    again = again.select("chunk", "dim", "held.query_id", "held.packed", "held.floor")
    visits = again.mapInArrow(tidy(visit), "block long, kind int, dim int, chunk long, ids array<long>, packs array<binary>, floor array<long>")
    far = _search(data_rows.unionByName(visits), k, leaf=512)
    hits = near.unionByName(far).select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select("query_id", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def _two_levels(x: np.ndarray, blocks: int, max_cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of the cells, those of their parts, and where each cell's parts begin: about as many parts as blocks, max_cells ** 1.5 at most."""
    tops = _centres(x, max(1, min(max_cells, round(blocks**0.5), len(x))))
    owner, parts = _nearest(x, tops), []
    for t in range(len(tops)):
        own = x[owner == t]
        share = round(blocks * len(own) / len(x))
        parts.append(_centres(own, max(1, min(int(max_cells**0.5), share))) if len(own) else tops[t : t + 1])
    return tops, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first centres of the sample, the first nearest its mean."""
    away = np.linalg.norm(x - x.mean(0), axis=1)
    out = [x[int(away.argmin())]]
    near = np.linalg.norm(x - out[0], axis=1)
    while len(out) < n and near.max() > 0:
        out.append(x[int(near.argmax())])
        near = np.minimum(near, np.linalg.norm(x - out[-1], axis=1))
    return np.stack(out)

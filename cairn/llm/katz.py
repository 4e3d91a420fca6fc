"""Katz backoff: Good-Turing discounted n-gram counts in partitioned tables, evaluated level by level per token.

P(w | h) = d(c(hw)) c(hw) / c(h) where the gram was seen, or else alpha(h) P(w | h'), h' being h without its
first word; alpha(h) = (1 - sum of the seen) / (1 - sum of P(w | h') over the words seen after h), so each history
sums to one. A history that wasn't seen passes the shorter one's probability on.

Texts are hashed once into chunks, which ask the partitions of the word table for their words' ids and counts. Level m of a
chunk asks the partitions of the m-gram table for its distinct grams, by the ids of the history (an (m - 1)-gram) and the
word; a partition counts, gives seen grams ids for the next level and answers each chunk in the order it asked. The chunk
is written anew with what it was told, and what stood before is deleted. A frequent history is split over partitions by
the next word; its sums are joined to the chunks that need them. Counts of counts, sums and ids stay in Spark; only
one row of totals a level reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, materialize, mix, release, word_hashes

K = 5
END = np.uint64(0xFEDCBA9876543211)
BEGIN_ID = 0  # of the empty beginning as a history; grams' ids begin at 1
_S = mix(np.arange(101, 109, dtype=np.uint64)) | np.uint64(1)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing ratios d[1..K] from counts of counts n[1..K + 1] (n[0] unused): Katz's, with d[0] = 0 and none above K.

    d[r] = (r*/r - a) / (1 - a) with r* = (r + 1) n[r + 1] / n[r] and a = (K + 1) n[K + 1] / n[1]. If that gives any d
    outside (0, 1), counts of counts are smoothed first: log n[r] becomes a straight line over log r, fitted
    by least squares to those that aren't nought (slope -2 if there are under two), and no flatter than slope -1.1.
    """

    def ratios(n) -> np.ndarray:
        r = np.arange(1, K + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            a = (K + 1) * n[K + 1] / n[1]
            return ((r + 1) * n[2 : K + 2] / (r * n[1 : K + 1]) - a) / (1 - a)

    n = np.array([0, *n[1:]], np.float64)
    d = ratios(n)
    if not ((d > 0) & (d < 1)).all():
        seen = np.flatnonzero(n > 0)
        slope = min(-1.1, np.polyfit(np.log(seen), np.log(n[seen]), 1)[0]) if len(seen) > 1 else -2.0
        d = ratios(np.concatenate(([0.0], np.arange(1, K + 2) ** slope)))
    return np.concatenate(([0.0], d))


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c; counts above K stay whole."""
    return np.where(c > K, c, d[np.minimum(c, K)] * c)


def shares(total, low: np.ndarray, big, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of histories with `total` tokens, low[r - 1] words seen r times and `big` tokens of words seen more than K times:
    what counts are divided by, and the mass left. A history whose words all were seen more than K times
    has one token more that goes to none of them."""
    total = np.asarray(total, np.float64)
    full = low.sum(0) == 0
    mass = (d[1:, None] * np.arange(1, K + 1)[:, None] * low).sum(0) + big
    divisor = total + full
    return divisor, np.where(full, 1.0, total - mass) / np.maximum(divisor, 1)


@dataclass(frozen=True)
class Model:
    """What the chunks and partitions need of the levels counted so far."""

    parts: int
    split: int
    order: int
    tokens: int
    types: int
    docs: int
    d: tuple[np.ndarray, ...] = ()
    divisor: float = 1.0
    left: float = 1.0

    def word_part(self, words: np.ndarray) -> np.ndarray:
        return (mix(words * _S[0]) % np.uint64(self.parts)).astype(np.int64)

    def copies(self, counts: np.ndarray) -> np.ndarray:
        """Over how many partitions a history is split."""
        return 1 + counts // self.split

    def gram_part(self, h: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            sub = mix(w.astype(np.uint64) * _S[1]) % self.copies(counts).astype(np.uint64)
            return (mix(h.astype(np.uint64) * _S[2] + sub * _S[3]) % np.uint64(self.parts)).astype(np.int64)

    def word_p(self, c: np.ndarray) -> np.ndarray:
        """Of words by training count; the mass left is shared by as many unseen types as there are seen ones."""
        return np.where(c > 0, discounted(c, self.d[0]) / self.divisor, self.left / max(self.types, 1))


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers from nought in the narrowest type, byte by byte, compressed; width and length go before."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def spread(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def squeeze_floats(x: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct values, and which one stands where."""
    values, at = np.unique(x, return_inverse=True)
    return values.tobytes(), squeeze(at)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


_CHUNK = "chunk long, n_docs long, n_train long, n_tokens long, ids array<long>, held_out array<boolean>, sizes binary, types binary, tokens binary"


def _pack(chunk_bytes: int):
    """Rows of (doc_id, text, held_out) as chunks of about chunk_bytes of text: their distinct words' hashes, and the place of each token's among these."""

    def chunk(number: int, ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
        words, at = word_hashes(texts)
        sizes = np.diff(at)
        tokens = np.insert(words, np.cumsum(sizes), END)
        types, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # small numbers for frequent words
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        values = (number, len(ids), len(ids) - sum(map(bool, held)), len(tokens), ids, held, squeeze(sizes + 1), types[order].tobytes(), squeeze(rank[place]))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.bool_())] + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [x.split()[0] for x in _CHUNK.split(", ")])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, t, h in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield chunk(number, ids, held, texts)
                    number += 1
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield chunk(number, ids, held, texts)

    return run


_ANSWER = "chunk long, level int, kind int, part long, counts binary, ids binary, mask binary, stats binary, lower binary, ctx array<long>, sums array<double>"
_ANSWER_NAMES = [x.split()[0] for x in _ANSWER.split(", ")]
_ANSWER_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.float64())]
#: Kinds of answers: to a chunk's message; split histories that a chunk needs; a partition's totals; its sums of a split history; joined sums of one.
REPLY, NEED, TOTALS, PART_SUMS, SUMS = range(5)


def _answers(rows: list[dict]) -> pa.Table:
    return pa.table([pa.array([r.get(n) for r in rows], t) for n, t in zip(_ANSWER_NAMES, _ANSWER_KINDS, strict=True)], _ANSWER_NAMES)


_STATE = "chunk long, ids array<long>, held_out array<boolean>, sizes binary, tokens binary, word_ids binary, word_counts binary, gram binary, count binary, p_values binary, p_at binary"
_STATE_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_STATE_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_())] + [pa.binary()] * 8


class Chunk:
    """A chunk's tokens; once read, with word ids and counts, and each token's longest gram so far (id, training count) and probability."""

    def __init__(self, row: dict, model: Model):
        self.row, self.model = row, model
        self.at = spread(row["tokens"])
        self.n = spread(row["sizes"])
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.first = np.cumsum(self.n) - self.n
        self.train = ~np.array([bool(x) for x in row["held_out"]], bool)
        if "types" in row:
            self.types = np.frombuffer(row["types"], np.uint64)
            return
        self.word_ids, self.word_counts = spread(row["word_ids"]), spread(row["word_counts"])
        self.word_id, self.word_count = self.word_ids[self.at], self.word_counts[self.at]
        if row["gram"]:
            self.gram, self.count = spread(row["gram"]), spread(row["count"])
            self.p = np.frombuffer(row["p_values"], np.float64)[spread(row["p_at"])]
        else:
            self.gram, self.count, self.p = self.word_id, self.word_count, model.word_p(self.word_count)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The order in which types are asked for, and where partitions begin in it."""
        part = self.model.word_part(self.types)
        order = np.argsort(part, kind="stable")
        return order, _runs(part[order])

    def read_words(self, replies: list[dict]) -> dict:
        """The chunk's state with word ids and counts for hashes."""
        order, edges = self.words()
        count, ids = np.zeros(len(self.types), np.int64), np.zeros(len(self.types), np.int64)
        by_part = {a["part"]: a for a in replies}
        part = self.model.word_part(self.types)
        for i in np.split(order, edges[1:]):
            a = by_part[int(part[i[0]])]
            count[i], ids[i] = spread(a["counts"]), spread(a["ids"])
        return {n: self.row.get(n) for n in _STATE_NAMES} | {"word_ids": squeeze(np.where(count > 0, ids, 0)), "word_counts": squeeze(count)}

    def state(self) -> dict:
        values, at = squeeze_floats(self.p)
        return self.row | {"gram": squeeze(self.gram), "count": squeeze(self.count), "p_values": values, "p_at": at}

    def scored(self) -> tuple:
        """The columns of the result."""
        m, docs = self.model, len(self.n)
        known = np.bincount(self.doc, weights=self.word_count > 0, minlength=docs).astype(np.int64)
        base = np.bincount(self.doc, weights=np.log10(self.word_count + 0.5), minlength=docs) - self.n * np.log10(m.tokens + 0.5 * (m.types + 1))
        score = np.bincount(self.doc, weights=np.log10(self.p), minlength=docs)
        return (pa.array(self.row["ids"], pa.int64()), pa.array(~self.train), pa.array(self.n), pa.array(known), pa.array(np.full(docs, m.tokens, np.int64)), pa.array(base), pa.array(score))

    def ask(self, level: int) -> None:
        """This level's distinct grams with a seen history, in the order (history, word), and their partitions. The beginning counts as
        one word: tokens with fewer than level - 1 before them keep the probability that the shorter history gave."""
        ctx, seen = np.concatenate(([0], self.gram[:-1])), np.concatenate(([0], self.count[:-1]))
        seen[np.arange(len(seen)) - self.first[self.doc] < level - 2] = 0
        if level == 2:
            ctx[self.first], seen[self.first] = BEGIN_ID, self.model.docs
        self.use = np.flatnonzero(seen > 0)
        h, h_at = np.unique(ctx[self.use], return_inverse=True)
        w, w_at = np.unique(self.word_id[self.use], return_inverse=True)
        pair, self.pair_at = np.unique(h_at * max(len(w), 1) + w_at, return_inverse=True)
        self.h, self.h_of = h, pair // max(len(w), 1)
        self.h_count = np.zeros(len(h), np.int64)
        self.h_count[h_at] = seen[self.use]
        self.w = w[pair % max(len(w), 1)]
        self.to = self.model.gram_part(h[self.h_of], self.w, self.h_count[self.h_of])
        self.order = np.argsort(self.to, kind="stable")
        self.edges = _runs(self.to[self.order])

    def read_grams(self, answers: list[dict], level: int) -> None:
        self.ask(level)
        d = self.model.d[level - 1]
        total, ids = np.zeros(len(self.w), np.int64), np.zeros(len(self.w), np.int64)
        divisor, alpha = self.h_count.astype(np.float64), np.full(len(self.h), np.nan)
        split = self.model.copies(self.h_count) > 1

        def settle(h: np.ndarray, low: np.ndarray, big: np.ndarray, lower: np.ndarray) -> None:
            divisor[h], left = shares(self.h_count[h], low, big, d)
            alpha[h] = left / np.maximum(1 - lower, 1e-300)

        by_part = {a["part"]: a for a in answers if a["kind"] == REPLY}
        for i in np.split(self.order, self.edges[1:]) if len(self.order) else []:
            a = by_part[int(self.to[i[0]])]
            total[i] = spread(a["counts"])
            if a["ids"]:
                ids[i] = spread(a["ids"])
            h = self.h_of[i][_runs(self.h_of[i])]
            h = h[np.unpackbits(np.frombuffer(a["mask"], np.uint8), count=len(h)).astype(bool)]
            stats = spread(a["stats"]).reshape(K + 1, -1)
            whole = ~split[h]
            settle(h[whole], stats[:K, whole], stats[K, whole], np.frombuffer(a["lower"], np.float64)[whole])
        late = [a for a in answers if a["kind"] == SUMS]
        if late:
            sums = np.array([a["sums"] for a in late]).T
            settle(np.searchsorted(self.h, np.array([a["ctx"][0] for a in late], np.int64)), sums[:K], sums[K], sums[K + 1])
        t, h = total[self.pair_at], self.h_of[self.pair_at]
        p, count, gram = self.p.copy(), np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        p[self.use] = np.where(t > 0, discounted(t, d) / divisor[h], alpha[h] * p[self.use])
        count[self.use], gram[self.use] = t, ids[self.pair_at]
        self.p, self.count, self.gram = p, count, gram


def _ask_words(model: Model):
    """The chunk's distinct words by partition, with their training counts."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                c = Chunk(row, model)
                train = np.bincount(c.at, weights=c.train[c.doc], minlength=len(c.types)).astype(np.int64)
                order, edges = c.words()
                part = model.word_part(c.types)
                for i in np.split(order, edges[1:]):
                    for column, x in zip(out, (int(part[i[0]]), row["chunk"], c.types[i].tobytes(), squeeze(train[i])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "chunk", "words", "counts"])

    return run


def _ids(total: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Ids of the counted from 1 on, by falling count in their partition, which is the remainder; 0 for what wasn't seen."""
    out = np.zeros(len(total), np.int64)
    order = np.argsort(-total, kind="stable")
    out[order] = np.arange(len(total)) * parts + part + 1
    return np.where(total > 0, out, 0)


def _totals(level: int, total: np.ndarray) -> dict:
    """Counts of counts up to K + 1, tokens, types and tokens of those seen more than K times."""
    low = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2]
    sums = [*low, total.sum(), (total > 0).sum(), total[total > K].sum()]
    return {"chunk": -1, "level": level, "kind": TOTALS, "sums": [float(x) for x in sums]}


def _count_words(model: Model):
    def run(key, table):
        part = key[0].as_py()
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        counts = [spread(x) for x in table.column("counts").to_pylist()]
        unique, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts).astype(np.float64), minlength=len(unique)).astype(np.int64)
        ids, begin, rows = _ids(total, part, model.parts), 0, [_totals(1, total)]
        for chunk, w in zip(table.column("chunk").to_pylist(), words, strict=True):
            here = at[begin : begin + len(w)]
            begin += len(w)
            rows.append({"chunk": chunk, "level": 1, "kind": REPLY, "part": part, "counts": squeeze(total[here]), "ids": squeeze(ids[here])})
        return _answers(rows)

    return run


_MESSAGE = "part long, chunk long, h binary, h_count binary, h_runs binary, w binary, train binary, lower_values binary, lower_at binary"
_MESSAGE_NAMES = [x.split()[0] for x in _MESSAGE.split(", ")]


def _ask_grams(model: Model, level: int):
    """The chunk's distinct grams of this level by partition, with their training counts and the shorter history's probability."""

    def messages(rows: list[dict]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in _MESSAGE_NAMES}
        for row in rows:
            c = Chunk(row, model)
            c.ask(level)
            train = np.bincount(c.pair_at, weights=c.train[c.doc[c.use]], minlength=len(c.w)).astype(np.int64)
            lower = np.zeros(len(c.w))
            lower[c.pair_at] = c.p[c.use]
            for i in np.split(c.order, c.edges[1:]) if len(c.order) else []:
                begin = _runs(c.h_of[i])
                h = c.h_of[i][begin]
                values, at = squeeze_floats(lower[i])
                data = (int(c.to[i[0]]), row["chunk"], squeeze(np.diff(c.h[h], prepend=0)), squeeze(c.h_count[h]), squeeze(np.diff(np.append(begin, len(i)))), squeeze(c.w[i]), squeeze(train[i]), values, at)
                for n, x in zip(_MESSAGE_NAMES, data, strict=True):
                    out[n].append(x)
        return out

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out = messages(batch.slice(i, 1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.int64() if n in ("part", "chunk") else pa.binary()) for n in _MESSAGE_NAMES], _MESSAGE_NAMES)

    return run


def _count_grams(model: Model, level: int):
    """Counts a partition's grams and answers the chunks; of histories with unseen words or without low counts it tells the sums too."""

    def run(key, table):
        part = key[0].as_py()
        get = {n: table.column(n).to_pylist() for n in _MESSAGE_NAMES}
        runs = [spread(x) for x in get["h_runs"]]
        histories = [np.cumsum(spread(x)) for x in get["h"]]
        sizes = [int(x.sum()) for x in runs]
        h = np.concatenate([np.repeat(a, b) for a, b in zip(histories, runs, strict=True)])
        h_count = np.concatenate([np.repeat(spread(a), b) for a, b in zip(get["h_count"], runs, strict=True)])
        w = np.concatenate([spread(x) for x in get["w"]])
        train = np.concatenate([spread(x) for x in get["train"]])
        lower = np.concatenate([np.frombuffer(a, np.float64)[spread(b)] for a, b in zip(get["lower_values"], get["lower_at"], strict=True)])
        order = np.lexsort((w, h))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])))
        first = np.flatnonzero(new)
        total = np.add.reduceat(train[order], first)
        gram_of = np.empty(len(h), np.int64)
        gram_of[order] = np.cumsum(new) - 1
        g_h, g_lower = h[order][first], lower[order][first]
        h_first = _runs(g_h)
        owner = np.repeat(np.arange(len(h_first)), np.diff(np.append(h_first, len(g_h))))
        low = np.stack([np.add.reduceat((total == r).astype(np.int64), h_first) for r in range(1, K + 1)])
        big = np.add.reduceat(np.where(total > K, total, 0), h_first)
        seen_lower = np.add.reduceat(np.where(total > 0, g_lower, 0.0), h_first)
        full = low.sum(0) == 0
        split = model.copies(h_count[order][first][h_first]) > 1
        ids = _ids(total, part, model.parts) if level < model.order else None
        rows, begin = [_totals(level, total)], 0
        for k in np.flatnonzero(split):
            rows.append({"chunk": -1, "level": level, "kind": PART_SUMS, "ctx": [int(g_h[h_first[k]])], "sums": [*map(float, low[:, k]), float(big[k]), float(seen_lower[k])]})
        for chunk, n, each in zip(get["chunk"], sizes, runs, strict=True):
            g = gram_of[begin : begin + n]
            begin += n
            starts = np.cumsum(each) - each
            own = owner[g[starts]]
            mask = np.add.reduceat((total[g] == 0).astype(np.int64), starts).astype(bool) | full[own]
            told = own[mask]
            reply = {"chunk": chunk, "level": level, "kind": REPLY, "part": part, "counts": squeeze(total[g]), "mask": np.packbits(mask).tobytes()}
            reply |= {"stats": squeeze(np.concatenate((low[:, told], big[None, told])).ravel()), "lower": seen_lower[told].tobytes()}
            if ids is not None:
                reply["ids"] = squeeze(ids[g])
            rows.append(reply)
            if split[told].any():
                rows.append({"chunk": chunk, "level": level, "kind": NEED, "ctx": [int(x) for x in g_h[h_first[told[split[told]]]]]})
        return _answers(rows)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED_NAMES = [x.split()[0] for x in _SCORED.split(", ")]
_SCORED_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _read(model: Model, level: int):
    """The chunk's state with the replies to this level's questions; of the last level, its documents' scores."""

    def run(key, chunks, answers):
        rows, tables = [], [pa.table([pa.array([], t) for t in _SCORED_KINDS], _SCORED_NAMES)]
        replies = answers.to_pylist()
        for row in chunks.to_pylist():
            c = Chunk(row, model)
            if level == 1:
                rows.append(c.read_words(replies))
            else:
                c.read_grams(replies, level)
                if level < model.order:
                    rows.append(c.state())
            if level > 1 and level == model.order:
                tables.append(pa.table(c.scored(), _SCORED_NAMES))
        if level > 1 and level == model.order:
            return pa.concat_tables(tables)
        return pa.table([pa.array([r[n] for r in rows], t) for n, t in zip(_STATE_NAMES, _STATE_KINDS, strict=True)], _STATE_NAMES)

    return run


def _score(model: Model):
    """Scores of chunks that ask nothing more (order 1)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(list(Chunk(row, model).scored()), _SCORED_NAMES)

    return run


def _sum_totals(answers: DataFrame) -> list[float]:
    row = answers.filter(F.col("kind") == TOTALS).agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(K + 4)]).first()
    return [x or 0.0 for x in row]


def score_documents(docs: DataFrame, folds: int = 5, held_fold: int = 1, order: int = 2, chunk_bytes: int = 4_000_000, part_tokens: int = 1_000_000, split: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Learns n-grams up to `order` from the rows whose crc32(doc_id as text) mod folds isn't held_fold; the base score is
    the smoothed unigram one, score the model's log10 probability, with the beginning as history of the first token. Discounts
    are those of discounts(), by level; counts above K aren't discounted, and a history whose counts all are above K
    has one token more, which goes to the unseen. Among words, the mass left is shared by as many unseen types as there
    are seen ones. A null text is empty (one token: the end), very long ones are taken whole; a null doc_id counts as the
    empty text for the fold. Repeated rows count as often as they stand. An empty table gives no rows, one without training rows
    scores 0 a token. Words are told apart by 64-bit hashes. Other columns are ignored, whatever their names. split: the count from
    which a history is dealt over partitions; by default part_tokens.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held_out = F.crc32(name.cast("binary")) % folds == held_fold
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    chunks = materialize(rows.mapInArrow(_pack(chunk_bytes), _CHUNK))
    n_docs, n_train, n_tokens = chunks.agg(F.sum("n_docs"), F.sum("n_train"), F.sum("n_tokens")).first()
    if not n_docs:
        discard(chunks)
        return spark.createDataFrame([], _SCORED)
    parts = max(16, -(-n_tokens // part_tokens))
    model = Model(parts, split or part_tokens, order, 0, 0, n_train)

    asked = chunks.mapInArrow(_ask_words(model), "part long, chunk long, words binary, counts binary")
    answers = materialize(asked.groupBy("part").applyInArrow(_count_words(model), _ANSWER))
    release(spark)
    *low, tokens, types, big = _sum_totals(answers)
    d = discounts([0, *low])
    divisor, left = shares(tokens, np.array(low[:K])[:, None], big, d)
    model = replace(model, tokens=int(tokens), types=int(types), d=(d,), divisor=float(divisor[0]), left=float(left[0]))
    state = _told(chunks, answers, None, model, 1)

    for level in range(2, order + 1):
        sent = state.mapInArrow(_ask_grams(model, level), _MESSAGE)
        answers = materialize(sent.groupBy("part").applyInArrow(_count_grams(model, level), _ANSWER))
        release(spark)
        *low, _, _, _ = _sum_totals(answers)
        model = replace(model, d=(*model.d, discounts([0, *low])))
        need = answers.filter(F.col("kind") == NEED).select("chunk", F.explode("ctx").alias("h")).distinct()
        sums = answers.filter(F.col("kind") == PART_SUMS).select(F.get("ctx", F.lit(0)).alias("h"), "sums")
        sums = sums.groupBy("h").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(K + 2)]).alias("sums"))
        none = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in _ANSWER.split(", ")[3:9])]
        late = need.join(sums, "h").select("chunk", F.lit(level).alias("level"), F.lit(SUMS).alias("kind"), *none, F.array("h").alias("ctx"), "sums")
        state = _told(state, answers, late, model, level)
    if order > 1:
        return state
    out = materialize(state.mapInArrow(_score(model), _SCORED))
    discard(state)
    return out


def _told(chunks: DataFrame, answers: DataFrame, late: DataFrame | None, model: Model, level: int) -> DataFrame:
    """The chunks with their replies; deletes both tables that it reads."""
    replies = answers.filter(F.col("kind") == REPLY)
    if late is not None:
        replies = replies.unionByName(late)
    schema = _SCORED if level > 1 and level == model.order else _STATE
    out = materialize(chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_read(model, level), schema))
    discard(chunks)
    discard(answers)
    release(chunks.sparkSession)
    return out

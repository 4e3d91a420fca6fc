"""Edit-aware token counts: a segment tree over each document's pre-token stretches.

A leaf holds a run of stretches that encode independently of what stands around
them, with its characters and tokens; inner nodes hold sums. An edit re-encodes
the leaves it touches, widened until both borders are again places where pieces
begin in any context, and updates the sums above them.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe import Encoder, encoding
from cairn.llm.common import few_at_a_time, tidy

EDITS = "array<struct<pos: bigint, n_deleted: bigint, inserted: string>>"


class TokenTree:
    def __init__(self, text: str, enc: Encoder, leaf: int = 32):
        self.enc, self.leaf = enc, leaf
        self.reencoded = 0
        self._build(text)

    @classmethod
    def of_leaves(cls, leaves: list[tuple[str, int]], enc: Encoder, leaf: int = 32) -> TokenTree:
        """A tree from its leaves (text, tokens) as leaves() gave them; nothing is encoded again."""
        out = cls.__new__(cls)
        out.enc, out.leaf, out.reencoded = enc, leaf, 0
        out._lay(leaves or [("", 0)])
        return out

    def leaves(self) -> list[tuple[str, int]]:
        """(text, tokens) of the leaves that hold text."""
        return [(t, self.tokens[self.size + i]) for i, t in enumerate(self.texts) if t]

    def _count(self, text: str) -> int:
        return self.enc.count(self.enc.stretches(text)) if text else 0

    def _build(self, text: str) -> None:
        cuts = self.enc.stretches(text) if text else []
        parts = [cuts[i : i + self.leaf] for i in range(0, len(cuts), self.leaf)] or [[]]
        self._lay([("".join(p), self.enc.count(p)) for p in parts])

    def _lay(self, leaves: list[tuple[str, int]]) -> None:
        """The tree over these leaves."""
        self.texts = [t for t, _ in leaves]
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (t, n) in enumerate(leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = len(t), n
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        i = self.size + leaf
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self._sum(i)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds the character at pos, and pos within it; the end belongs to the last leaf with text."""
        i = 1
        if pos >= self.chars[1]:
            pos = self.chars[1]
            last = len(self.texts) - 1
            while last and not self.texts[last]:
                last -= 1
            return last, len(self.texts[last])
        while i < self.size:
            i *= 2
            if pos >= self.chars[i]:
                pos -= self.chars[i]
                i += 1
        return i - self.size, pos

    def _beside(self, leaf: int, step: int) -> int:
        """The next leaf with text in that direction, or -1."""
        leaf += step
        while 0 <= leaf < len(self.texts) and not self.texts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.texts) else -1

    def edit(self, pos: int, n_deleted: int, inserted: str) -> None:
        """Replace n_deleted characters at pos; positions beyond the end mean the end."""
        total = self.chars[1]
        pos = min(max(pos, 0), total)
        end = min(pos + max(n_deleted, 0), total)
        first, at = self._find(pos)
        last, stop = self._find(end)
        if first == last:
            region = self.texts[first][:at] + inserted + self.texts[first][stop:]
        else:
            region = self.texts[first][:at] + inserted + self.texts[last][stop:]
        while True:
            left, right = self._beside(first, -1), self._beside(last, 1)
            if left >= 0 and not (len(region) > 1 and region[0] == " " and not region[1].isspace() and not self.texts[left][-1].isspace()):
                region, first = self.texts[left] + region, left
            elif right >= 0 and (not region or region[-1].isspace()):
                region, last = region + self.texts[right], right
            else:
                break
        tokens = self._count(region)
        self.reencoded += tokens
        for i in range(first + 1, last + 1):
            self._set(i, "", 0)
        self._set(first, region, tokens)
        if len(region) > 64 * self.leaf * 8:
            self._rebuild_long(first)

    def _rebuild_long(self, leaf: int) -> None:
        """A leaf that has grown long is cut up again; the tree is laid out anew from the leaves' known sums."""
        cuts = self.enc.stretches(self.texts[leaf])
        parts = ["".join(cuts[i : i + self.leaf]) for i in range(0, len(cuts), self.leaf)]
        known = [(t, self.tokens[self.size + i]) for i, t in enumerate(self.texts)]
        known[leaf : leaf + 1] = [(p, self._count(p)) for p in parts]
        self._lay([x for x in known if x[0]] or [("", 0)])


    def apply(self, edits: list[dict | None] | None) -> None:
        """Edits in order, each to the text that the ones before left; nulls are 0 or empty."""
        for e in edits or []:
            e = e or {}
            self.edit(e.get("pos") or 0, e.get("n_deleted") or 0, e.get("inserted") or "")


_LEAVES = "array<struct<text: string, n_tokens: int>>"
_KEPT = pa.list_(pa.struct([("text", pa.string()), ("n_tokens", pa.int32())]))


def _dumped(tree: TokenTree) -> list[dict]:
    return [{"text": t, "n_tokens": n} for t, n in tree.leaves()]


def token_trees(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, version (0), n_tokens, leaves: each document's tree as its leaves, to write and edit later by edit_trees().

    A null text is empty and has no leaves; repeated rows give repeated trees, an empty table none; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())  # a file of fixed size, under 1 MB

    def run(batches):
        with encoding(held.value, pattern) as enc:
            for batch in few_at_a_time(batches):
                trees = [TokenTree(t or "", enc) for t in batch.column(1).to_pylist()]
                kept = pa.array([_dumped(t) for t in trees], _KEPT)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(trees), pa.int32()), pa.array([t.n_tokens for t in trees], pa.int64()), kept], ["doc_id", "version", "n_tokens", "leaves"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), f"doc_id long, version int, n_tokens long, leaves {_LEAVES}")


def edit_trees(trees: DataFrame, edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, version, n_tokens, leaves, n_reencoded of all trees (doc_id, version, leaves): those that edits (doc_id, edits) names are
    edited and their version rises by one, with n_reencoded tokens encoded again; the others stay as they are.

    Several rows of edits of one document apply in the order of their column `turn` where there is one. Trees and edits meet by
    doc_id; a null one has no edits.
    """
    held = trees.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    order = "turn" if "turn" in edits.columns else "edits"
    todo = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("edits").cast(EDITS).alias("e")))).alias("all"))
    todo = todo.select("doc_id", F.flatten(F.transform("all", lambda x: F.coalesce(x["e"], F.expr(f"cast(array() as {EDITS})")))).alias("edits"))

    def run(batches):
        with encoding(held.value, pattern) as enc:
            for batch in batches:
                versions, counts, kept, again = [], [], [], []
                for version, leaves, own in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    tree = TokenTree.of_leaves([(x["text"], x["n_tokens"]) for x in leaves or []], enc)
                    tree.apply(own)
                    for column, x in zip((versions, counts, kept, again), (version + (own is not None), tree.n_tokens, _dumped(tree), tree.reencoded), strict=True):
                        column.append(x)
                columns = [batch.column(0), pa.array(versions, pa.int32()), pa.array(counts, pa.int64()), pa.array(kept, _KEPT), pa.array(again, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "n_tokens", "leaves", "n_reencoded"])

    held_rows = trees.select("doc_id", "version", "leaves").join(todo, "doc_id", "left")
    return held_rows.mapInArrow(tidy(run), f"doc_id long, version int, n_tokens long, leaves {_LEAVES}, n_reencoded long")


def count_with_edits(docs: DataFrame, edits: Column, ranks_path: str, pattern: str, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_reencoded (and text_edited) of every whole text.

    edits: a column of docs, an array of (pos, n_deleted, inserted) in code points, applied in
    order, each to the text that the ones before left. A null text is empty, a null list has no
    edits, null positions and lengths are 0, a null insertion is empty. Very long texts are taken whole. Repeated rows give
    repeated results; an empty table gives none; other columns are ignored. token_trees() and edit_trees() do the same with trees that are kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())  # a file of fixed size, under 1 MB
    schema = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long" + ", text_edited string" * keep_text

    def run(batches):
        with encoding(held.value, pattern) as enc:
            for batch in few_at_a_time(batches):
                out: list[list] = [[], [], [], [], []]
                for text, todo in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    tree = TokenTree(text or "", enc)
                    before = tree.n_tokens
                    tree.apply(todo)
                    for column, x in zip(out, (before, len(todo or []), tree.n_tokens, tree.reencoded, tree.text if keep_text else None), strict=True):
                        column.append(x)
                columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:4]]]
                names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"]
                if keep_text:
                    columns, names = [*columns, pa.array(out[4], pa.string())], [*names, "text_edited"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text", edits.cast(EDITS).alias("edits")).mapInArrow(tidy(run), schema)


def sample_edits(text: Column) -> Column:
    """Three edits that depend on the text alone: at its start, after a third and after two thirds."""
    n = F.coalesce(F.length(text), F.lit(0))
    parts = [(F.lit(0), 0, "Note: "), (F.floor(n / 3), 7, ""), (F.floor(2 * n / 3), 3, " revised,")]
    return F.array(*[F.struct(p.cast("long").alias("pos"), F.lit(d).cast("long").alias("n_deleted"), F.lit(s).alias("inserted")) for p, d, s in parts])

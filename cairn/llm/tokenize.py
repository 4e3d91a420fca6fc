"""Byte-level BPE encoding and decoding of documents."""

from __future__ import annotations

import hashlib
from array import array
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe import decode_stream, encoder, encoding
from cairn.llm.common import few_at_a_time, tidy


def _vocabulary(docs: DataFrame, ranks_path: str):
    """The rank file's bytes as a broadcast: a file of fixed size, under 1 MB for 50,000 tokens."""
    return docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of every row's whole text; a null text is empty and has no ids.

    Rows stay as they are: repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    held = _vocabulary(docs, ranks_path)

    def run(batches):
        with encoding(held.value, pattern) as enc:
            for batch in few_at_a_time(batches):
                ids = [enc.encode(t) if t else [] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text and bytes of ids; bytes that aren't UTF-8 become replacement characters in text."""
    held = _vocabulary(encoded, ranks_path)

    def run(batches):
        bytes_of = encoder(held.value, "").transducer.bytes_of
        for batch in batches:
            data, texts = [], []
            for ids in batch.column(1).to_pylist():
                parts = list(decode_stream(bytes_of, ids or []))
                data.append(b"".join([p[0] for p in parts]))
                texts.append("".join([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(data, pa.binary())], ["doc_id", "text", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, keep: tuple[str, ...] = (), memory: int = 400_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids), then the whole-number columns named in keep: encodes, then decodes the ids,
    one text at a time. memory bounds what a worker holds (see bpe.encoding): less is slower, with the same result.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded bytes.
    A null text is empty, a very long one is taken whole; repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    held = _vocabulary(docs, ranks_path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + "".join(f", `{c}` long" for c in keep)

    def run(batches):
        with encoding(held.value, pattern, memory) as enc:
            bytes_of = enc.transducer.bytes_of
            for batch in few_at_a_time(batches):
                counts, packed, decoded, kept = [], [], [], []
                for t in batch.column(1).to_pylist():
                    ids = enc.encode(t) if t else []
                    counts.append(len(ids))
                    if keep_ids:
                        kept.append(pa.array(ids, pa.int32()))
                    packed.append(hashlib.sha256(array("I", ids).tobytes()).hexdigest())
                    back = hashlib.sha256()
                    for data, _ in decode_stream(bytes_of, ids):
                        back.update(data)
                    decoded.append(back.hexdigest())
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    edges = pa.array([0, *accumulate(counts)], pa.int32())
                    values = pa.concat_arrays(kept) if kept else pa.array([], pa.int32())
                    columns, names = [*columns, pa.ListArray.from_arrays(edges, values)], [*names, "ids"]
                columns, names = [*columns, *batch.columns[2:]], [*names, *keep]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text", *[F.col(f"`{c}`").cast("long") for c in keep]).mapInArrow(tidy(run), schema)

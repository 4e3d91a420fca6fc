"""The retrieval plan: two pools, exclusions, fusion, and context for an injected model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import kernels
from cairn.operators import dense, fusion, lexical, policy


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Model(Protocol):
    def chat(self, messages: list[dict]) -> str: ...


class StubModel:
    """Deterministic: quotes the first block and says it used it."""

    def chat(self, messages: list[dict]) -> str:
        blocks = [x for x in messages[-1]["content"].split("\n") if x.startswith("[1]")]
        return (blocks[0][4:84] if blocks else "NONE") + "\nUSED: 1"


@dataclass
class Answer:
    status: str
    text: str = ""
    citations: list[str] = field(default_factory=list)


def retrieve(concepts: DataFrame, vectors: DataFrame | None, relations: DataFrame, question: str, query_vector: list[float] | None, limit: int = 5, pool: int = 10, include_deprecated: bool = False, include_confidential: bool = False, local_exemption: bool = False) -> DataFrame:
    """(concept_id, score, rank). Each channel is cut to max(limit, pool) first, then excluded documents go and ranks are
    given anew, then the channels are fused: the filter never moves below the cut."""
    width = max(limit, pool)
    gone = policy.sensitive(concepts, include_confidential=include_confidential, local_exemption=local_exemption)
    if not include_deprecated:
        gone = gone.union(policy.deprecated(concepts, relations)).distinct()
    fts = lexical.search(concepts, ["title", "body"], lexical.quote(question), width)
    channels = [fusion.excluded(fts, gone, ["score", "concept_id"]).select("concept_id", "rank")]
    if vectors is not None and query_vector is not None:
        vec = dense.nearest(vectors, query_vector, width)
        channels.append(fusion.excluded(vec, gone, ["distance", "concept_id"]).select("concept_id", "rank"))
    return fusion.fuse(*channels, limit=limit)


def context(hits: DataFrame, concepts: DataFrame, include_confidential: bool = False) -> DataFrame:
    """(rank, concept_id, title, body, confidential) of hits that can be read and sent."""
    from cairn.functions.expr import blocks_send, rank

    held = hits.join(concepts.select("concept_id", "title", "body", "sensitivity"), "concept_id").filter("body is not null")
    if not include_confidential:
        held = held.filter(~blocks_send(F.col("sensitivity")))
    return held.select("rank", "concept_id", "title", "body", (rank(F.col("sensitivity")) == 2).alias("confidential")).orderBy("rank")


def answer(question: str, hits: DataFrame, concepts: DataFrame, model: Model, sufficient: Callable[[str, str], bool] | None = None, limit: int = 5) -> Answer:
    """Asks the model over at most limit blocks; the one action collects just these rows."""
    if not question.strip():
        return Answer("empty_query")
    rows = context(hits, concepts).limit(limit).collect()
    if not rows:
        return Answer("zero_hits")
    blocks = "\n".join(f"[{i}] {r['title']}: {r['body']}" for i, r in enumerate(rows, 1))
    if sufficient is not None and not sufficient(question, blocks):
        return Answer("insufficient_context")
    prose, status, used = kernels.split_attribution(model.chat([{"role": "user", "content": f"{blocks}\n\n{question}"}]), len(rows))
    cited = used if status == "reported" else range(1, len(rows) + 1)
    return Answer("answered", prose, [rows[i - 1]["concept_id"] for i in cited])

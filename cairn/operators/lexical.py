"""Lexical index and search: tokens, postings, phrases, BM25, top-k."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"


def _folds() -> dict[str, str]:
    """Latin letters with one mark to those without; such marks of their own to nothing."""
    held, alone = {"ſ": "s"}, set()
    for c in map(chr, range(0xC0, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", c)
        if len(marks) == 1 and base.isascii() and base.isalpha() and unicodedata.combining(marks[0]):
            held[c] = base.lower()
            alone.add(marks[0])
    return held | dict.fromkeys(alone, "")


#: Letters first: translate() drops what has no counterpart.
FOLDS = _folds()
_FROM, _TO = "".join(sorted(FOLDS, key=lambda c: not FOLDS[c])), "".join(filter(None, (FOLDS[c] for c in sorted(FOLDS, key=lambda c: not FOLDS[c]))))


def tokens(*columns: Column) -> Column:
    """Lower-case runs of letters and digits of all columns, in order, without diacritics."""
    text = F.translate(F.lower(F.concat_ws(" ", *columns)), _FROM, _TO)
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def index(concepts: DataFrame, *columns: str) -> DataFrame:
    """Postings (term, concept_id, position) of the given text columns; write them partitioned by a hash of the term."""
    held = concepts.select("concept_id", F.posexplode(tokens(*[F.col(c) for c in columns])).alias("position", "term"))
    return held.select("term", "concept_id", "position")


def statistics(postings: DataFrame) -> DataFrame:
    """(concept_id, dl) of the indexed documents."""
    return postings.groupBy("concept_id").agg(F.count(F.lit(1)).alias("dl"))


def quote(question: str) -> list[list[str]]:
    """White-space tokens, each a phrase of its own terms; tokens without a term match nothing."""
    import re

    table = str.maketrans(FOLDS)
    return [p for raw in question.split() if (p := re.findall(r"[^\W_]+", raw.lower().translate(table)))]


def _occurrences(held: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(held, lambda t: t == phrase[0]))
    same = lambda t, i: reduce(lambda a, b: a & b, [F.coalesce(F.get(held, i + k) == w, F.lit(False)) for k, w in enumerate(phrase)])
    return F.size(F.filter(held, same))


def search(concepts: DataFrame, columns: list[str], phrases: list[list[str]], limit: int) -> DataFrame:
    """The limit best documents (concept_id, score, rank) that hold any phrase; lower scores are better, ties by id.

    One scan: term counts per document, then one row of collection statistics joined back. Blank questions give no rows.
    """
    empty = concepts.sparkSession.createDataFrame([], "concept_id string, score double, rank int")
    phrases = [list(x) for x in dict.fromkeys(map(tuple, phrases))]
    if not phrases:
        return empty
    # The tokens are bound by a lambda: inside the lambdas of phrases they would else be made anew for each position.
    count = lambda t: F.struct(F.size(t).alias("_dl"), *[_occurrences(t, p).alias(f"_f{i}") for i, p in enumerate(phrases)])
    counted = concepts.select("concept_id", F.get(F.transform(F.array(tokens(*[F.col(c) for c in columns])), count), F.lit(0)).alias("_c")).select("concept_id", "_c.*")
    whole = counted.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(phrases))])

    def part(i: int) -> Column:
        n, f = F.col(f"_n{i}"), F.col(f"_f{i}")
        idf = F.log((F.col("_docs") - n + 0.5) / (n + 0.5))
        return F.when(idf > 0, idf).otherwise(1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("_dl") / F.col("_avg")))

    hit = reduce(lambda a, b: a | b, [F.col(f"_f{i}") > 0 for i in range(len(phrases))])
    scored = counted.filter(hit).crossJoin(F.broadcast(whole))  # whole is one row
    scored = scored.select("concept_id", F.round(-sum((part(i) for i in range(len(phrases))), F.lit(0.0)), 9).alias("score"))
    return ranked(scored, [F.col("score"), F.col("concept_id")], limit)


def ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first limit rows with rank from 1; ranks are given after the cut, to limit rows."""
    from pyspark.sql import Window as W

    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))


def phrase_hits(postings: DataFrame, phrase: list[str]) -> DataFrame:
    """(concept_id, n) by self-joins of the postings on position + 1: for an index on disk, partitioned by term."""
    first = postings.filter(F.col("term") == phrase[0]).select("concept_id", F.col("position").alias("_p"))
    for k, w in enumerate(phrase[1:], 1):
        step = postings.filter(F.col("term") == w).select("concept_id", (F.col("position") - k).alias("_p"))
        first = first.join(step, ["concept_id", "_p"])
    return first.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))


def _word_runs(folded: Column) -> Column:
    """Hashes of all runs of two, three and four words."""
    runs = lambda w, n: F.filter(F.transform(w, lambda x, i: F.when(i + n <= F.size(w), F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))), lambda h: h.isNotNull())
    return F.get(F.transform(F.array(F.split(folded, " ")), lambda w: F.array_distinct(F.concat(*[runs(w, n) for n in (2, 3, 4)]))), F.lit(0))


def evidence_pairs(bodies: DataFrame, sources: DataFrame) -> DataFrame:
    """(body_id, source_id, evidence) of all pairs of a body (body_id, body) and a source (source_id, text) that share a line of evidence.

    A shared line stands whole in the other text, so that text holds the words between the line's ends, in a row: only pairs that share
    such a run, of one's line in the other, are compared. Nulls have no lines.
    """
    from cairn.functions.text_udfs import evidence_line, folded_text, line_keys

    def lines(df: DataFrame, name: str, text: str) -> DataFrame:
        return df.select(name, F.explode(line_keys(text)).alias("key")).select(name, F.xxhash64("key").alias("key"))

    def runs(df: DataFrame, name: str, text: str) -> DataFrame:
        return df.select(name, folded_text(text).alias("_f")).select(name, F.explode(_word_runs(F.col("_f"))).alias("key"))

    down = runs(sources, "source_id", "text").join(lines(bodies, "body_id", "body"), "key").select("body_id", "source_id")
    up = lines(sources, "source_id", "text").join(runs(bodies, "body_id", "body"), "key").select("body_id", "source_id")
    pairs = down.union(up).distinct().join(bodies, "body_id").join(sources, "source_id")
    return pairs.select("body_id", "source_id", evidence_line("body", "text").alias("evidence")).filter("evidence is not null")

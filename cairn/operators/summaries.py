"""Surveys, listings, unions of extracted objects, ranked next action, merges of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import expr


def survey(concepts: DataFrame) -> DataFrame:
    """(type, n) of all typed documents."""
    return concepts.filter("type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def list_objects(concepts: DataFrame, deprecated: DataFrame, limit: int = 50) -> DataFrame:
    """(concept_id, link_dir, title, sensitivity, status): titles on one line, unknown levels named so; first `limit` by id."""
    flag = deprecated.select("concept_id", F.lit("deprecated").alias("_d"))
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"[ \t\r\n]+", " "))
    out = concepts.join(flag, "concept_id", "left").select("concept_id", F.split_part("concept_id", F.lit("/"), F.lit(1)).alias("link_dir"), title.alias("title"), F.coalesce(F.when(F.trim("sensitivity") != "", F.col("sensitivity")), F.lit("unknown")).alias("sensitivity"), F.coalesce("_d", F.lit("active")).alias("status"))
    return out.orderBy("concept_id").limit(limit)


def union_merge(objects: DataFrame) -> DataFrame:
    """Of objects alike in (source, type, key) the one with the longest body, then description, then the first; in order of first appearance."""
    group = W.partitionBy("source", "type", "key")
    best = F.row_number().over(group.orderBy(F.desc(F.length("body")), F.desc(F.length("description")), "pos"))
    first = F.min("pos").over(group)
    return objects.withColumn("first_pos", first).withColumn("_n", best).filter("_n = 1").drop("_n")


def first_wins(objects: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("source", "type", "key").orderBy("pos"))
    return objects.withColumn("_n", place).filter("_n = 1").drop("_n")


def next_action(signals: DataFrame) -> DataFrame:
    """The first firing of the ordered tiers: signals has tier, subject, n (firing if above nought)."""
    return signals.filter("n > 0").orderBy("tier", "subject").limit(1)


# A speaker's turn in a transcript (an optional time, a label, a colon, then speech), and words that name a gathering.
TURN = r"^\s{0,4}(?:[\[(]\d{1,2}:\d{2}(?::\d{2})?[\])]\s+|\d{1,2}:\d{2}(?::\d{2})?\s+)?([^\s:#\->*+|`][^:\n]{0,39}):\s+\S"
GATHERING = r"(?i)\b(meeting|standup|retrospective|kickoff|huddle|reuni[oó]n(?:es)?)\b"


def transcript_shape(docs: DataFrame, min_turns: int = 3, min_speakers: int = 2, min_total: int = 10) -> DataFrame:
    """doc_id, speakers, recurring, lines, is_transcript of every body: enough labels recur often enough, and their turns are half of the
    lines that aren't blank. Labels of over three words, with a digit, or of three letters and more in capitals are none."""
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != "")
    label = F.trim(F.regexp_extract("line", TURN, 1))
    shouted = (F.length("label") >= 3) & (F.col("label") == F.upper("label")) & (F.col("label") != F.lower("label"))
    speaks = (F.col("label") != "") & (F.size(F.split("label", r"\s+")) <= 3) & ~F.col("label").rlike(r"\d") & ~shouted
    turns = docs.select("doc_id", F.explode_outer(lines).alias("line")).select("doc_id", F.col("line").isNotNull().alias("filled"), label.alias("label"))
    per = turns.withColumn("label", F.when(speaks, F.col("label"))).groupBy("doc_id", "label").agg(F.count_if("filled").alias("n"))
    often = F.col("label").isNotNull() & (F.col("n") >= min_turns)
    agg = per.groupBy("doc_id").agg(F.count_if(often).alias("speakers"), F.sum(F.when(often, F.col("n")).otherwise(0)).alias("recurring"), F.sum("n").alias("lines"))
    return agg.withColumn("is_transcript", (F.col("speakers") >= min_speakers) & (F.col("recurring") >= min_total) & (2 * F.col("recurring") >= F.col("lines")))


def meeting_shaped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, title, body) with meeting: the title names a gathering, or the body has the shape of a transcript."""
    shape = transcript_shape(docs).select("doc_id", F.col("is_transcript").alias("_t"))
    return docs.join(shape, "doc_id", "left").withColumn("meeting", F.coalesce("title", F.lit("")).rlike(GATHERING) | F.coalesce("_t", F.lit(False))).drop("_t")


def dominant_language(docs: DataFrame) -> DataFrame:
    """docs with language: en or es where its function words are more than twice the other's; null else."""
    from cairn.vocabulary import ENGLISH, SPANISH

    found = expr.words(F.col("body"))
    count = lambda names: F.size(F.filter(found, lambda w: w.isin(*names)))
    out = docs.withColumn("n_en", count(ENGLISH)).withColumn("n_es", count(SPANISH))
    en, es = F.col("n_en"), F.col("n_es")
    return out.withColumn("language", F.when(en > 2 * es, "en").when(es > 2 * en, "es"))


def line_windows(text: Column, target: int = 4000) -> Column:
    """In how many windows of at most target characters whole lines pack; a longer line is a window of its own."""
    costs = F.transform(F.split(text, "\n", -1), lambda x: F.length(x) + 1)
    begin = F.struct(F.lit(0).alias("n"), F.lit(target).alias("held"))
    opens = lambda s, c: s["held"] + c > target
    pack = lambda s, c: F.struct((s["n"] + F.when(opens(s, c), 1).otherwise(0)).alias("n"), F.when(opens(s, c), c).otherwise(s["held"] + c).alias("held"))
    return F.aggregate(costs, begin, pack, lambda s: s["n"])


def extraction_cost(sources: DataFrame, target: int = 4000, chunk_from: int = 18_000, meeting_from: int = 12_000, union_judge: bool = True) -> DataFrame:
    """(concept_id, windows, calls) of sources (body, meeting): texts longer than chunk_from (meeting_from if meeting-shaped) take a call a
    window. Others take two, or one without the judge; with it come one more for a meeting's people and one for the judge."""
    body = F.coalesce("body", F.lit(""))
    long = F.length(body) > F.when(F.col("meeting"), meeting_from).otherwise(chunk_from)
    windows = F.when(long, line_windows(body, target)).otherwise(0)
    plain = F.when(long, F.col("windows")).otherwise(2 if union_judge else 1)
    extra = F.when(F.col("meeting"), 2).otherwise(1) if union_judge else F.lit(0)
    return sources.withColumn("windows", windows).select("concept_id", F.col("windows").cast("long").alias("windows"), (plain + extra).cast("long").alias("calls"))


def judge_admission(candidates: DataFrame, selected: DataFrame, cap: int = 20) -> DataFrame:
    """candidates (source, key, type, pos, meeting) that stay: selected by key, procedures always, people and organisations in
    meetings; all of a source whose selection is empty; the first `cap` by position."""
    hit = selected.select("source", "key").distinct().withColumn("_s", F.lit(True))
    held = candidates.join(hit, ["source", "key"], "left")
    chosen = F.coalesce("_s", F.lit(False))
    own = F.count_if(chosen).over(W.partitionBy("source"))
    keep = chosen | (F.col("type") == "Procedure") | (F.col("meeting") & F.col("type").isin("Person", "Organization"))
    kept = held.withColumn("_o", own).filter((F.col("_o") == 0) | keep)
    return kept.withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy("pos"))).filter(F.col("_n") <= cap).drop("_s", "_o", "_n")


def verdicts(replies: DataFrame) -> DataFrame:
    """replies (verdict, confidence, claims) made safe: null and blank claims go, unknown verdicts and contradictions without claims are UNCERTAIN."""
    replies = replies.withColumn("claims", F.filter("claims", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    name = F.upper(F.trim("verdict"))
    known = F.when(name.isin("CONTRADICTS", "CONSISTENT", "UNCERTAIN"), name).otherwise("UNCERTAIN")
    bare = (known == "CONTRADICTS") & (F.coalesce(F.size("claims"), F.lit(0)) <= 0)
    return replies.withColumn("confidence", expr.confidence(F.col("confidence"))).withColumn("verdict", F.when(bare, "UNCERTAIN").otherwise(known))


def birth_level(objects: DataFrame, offsets: dict[str, int], base: str, default: str = "private") -> DataFrame:
    """objects (type) with sensitivity: the stricter of base and the default raised by the type's offset."""
    cases = [F.when(F.col("type") == t, expr.combine(F.lit(base), expr.raise_by(F.lit(default), n))) for t, n in sorted(offsets.items())]
    plain = expr.level_of(expr.rank(F.lit(base)))
    return objects.withColumn("sensitivity", F.coalesce(*cases, plain) if cases else plain)


def merged_list(a: Column, b: Column) -> Column:
    """a, then what b adds; a keeps its own repeats."""
    return F.concat(a, F.array_distinct(F.array_except(b, a)))


def merged_relations(a: Column, b: Column, survivor: Column, absorbed: Column) -> Column:
    """The survivor's relations a and the absorbed's b, without repeats, sorted by (target, type). Relations between the two would be self-loops and
    go, as do the absorbed's own; a self-loop that the survivor has already stays."""
    own = F.filter(a, lambda r: ~r["target"].eqNullSafe(absorbed))
    moved = F.filter(b, lambda r: ~(r["target"].eqNullSafe(absorbed) | r["target"].eqNullSafe(survivor)))
    return F.array_sort(F.array_distinct(F.concat(own, moved)))


def resource_reason(resource: Column) -> Column:
    """Why a resource isn't raw/<name>; null if it is."""
    parts = F.split(resource, "/")
    return (
        F.when(resource.isNull() | (F.trim(resource) == ""), "missing")
        .when(resource.contains("\\"), "backslash")
        .when(F.array_contains(parts, ".."), "parent")
        .when((F.size(parts) != 2) | (F.get(parts, F.lit(0)) != "raw") | (F.get(parts, F.lit(1)) == ""), "shape")
    )


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

"""Integrity checks; each gives (kind, path, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.expr import level_of, rank, window_days
from cairn.vocabulary import ENGINE_RELATIONS, OBJECT_TYPES, TIERS


def _finding(df: DataFrame, kind: str, path: str, detail) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(path).alias("path"), detail.cast("string").alias("detail"))


def window_for(docs: DataFrame, type_tiers: dict[str, str] | None = None, fallback: int = 7) -> DataFrame:
    """docs with window_days (null: never stale): the document's volatility, then the configured tier of a registered type,
    then the type's default, then the fallback."""
    default = {t: tier for t, _, _, _, tier in OBJECT_TYPES}
    chosen = default | {t: v for t, v in (type_tiers or {}).items() if t in default and v in TIERS}
    by_type = F.create_map(*[F.lit(x) for kv in chosen.items() for x in kv])
    own = F.when(F.col("volatility").isin(*TIERS), F.col("volatility"))
    tier = F.coalesce(own, by_type[F.coalesce("type", F.lit(""))])
    days = F.when(tier == "slow", TIERS["slow"]).when(tier == "volatile", TIERS["volatile"])
    return docs.withColumn("window_days", F.when(tier == "static", None).otherwise(F.coalesce(days, F.lit(fallback))))


def stale_stamps(docs: DataFrame, today: str) -> DataFrame:
    """`(as of YYYY-MM-DD)` stamps older than window_days by a day or more; one finding per document and stamp; bad dates don't count."""
    stamp = docs.filter("window_days is not null and coalesce(freshness, '') <> 'snapshot'").select("path", "window_days", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\(as of (\d{4}-\d{2}-\d{2})\)"), F.lit(1)))).alias("stamp"))
    age = F.datediff(F.lit(today).cast("date"), F.expr("try_to_date(stamp, 'yyyy-MM-dd')"))
    return _finding(stamp.withColumn("age", age).filter("age > window_days"), "stale-stamp", "path", F.concat_ws(" ", "stamp", "age"))


def orphans(docs: DataFrame, references: DataFrame) -> DataFrame:
    """Documents that neither the index nor another document's body names; relations don't count. references: source_id (null: index), target_id."""
    hit = references.filter("source_id is null or source_id <> target_id").select(F.col("target_id").alias("path"))
    return _finding(docs.select("path").join(hit, "path", "left_anti"), "orphan", "path", F.lit(""))


def dangling(docs: DataFrame, references: DataFrame, kind: str = "dangling-target") -> DataFrame:
    """Targets that don't exist, once per document; a document's own id is ignored."""
    ids = docs.select(F.col("path").alias("target_id"))
    out = references.filter("source_id <> target_id").select("source_id", "target_id").distinct().join(ids, "target_id", "left_anti")
    return _finding(out, kind, "source_id", F.col("target_id"))


def dangling_provenance(docs: DataFrame, provenance: DataFrame) -> DataFrame:
    """Cited documents that don't exist, but for the document's own resource with or without .md. provenance: child, parent, resource."""
    ids = docs.select(F.col("path").alias("parent"))
    own = F.regexp_replace(F.coalesce("resource", F.lit("")), r"\.md$", "")
    out = provenance.withColumn("parent", F.regexp_replace("parent", r"\.md$", "")).filter(F.col("parent") != own).join(ids, "parent", "left_anti")
    return _finding(out.select("child", "parent").distinct(), "dangling-provenance", "child", F.col("parent"))


def unbacked(relations: DataFrame, provenance: DataFrame) -> DataFrame:
    """Relations of engine-owned types whose target the document's own provenance doesn't name."""
    own = provenance.select(F.col("child").alias("source_id"), F.col("parent").alias("target_id"))
    out = relations.filter(F.col("relation_type").isin(*ENGINE_RELATIONS)).select("source_id", "target_id").distinct().join(own, ["source_id", "target_id"], "left_anti")
    return _finding(out, "unbacked-relation", "source_id", F.col("target_id"))


# Notices that an extraction can leave, with what they mean.
UNJUDGED = {"judge-selection-unavailable": "judge unavailable", "judge-selection-empty": "judge reply matched no candidate"}
UNEVIDENCED = "objects-without-evidence"


def status_findings(docs: DataFrame) -> DataFrame:
    """Sources whose extraction failed, whose candidates were kept without a judge, or that stored an object without a line of evidence.
    Notices that aren't known say nothing."""
    failed = _finding(docs.filter("extraction_status = 'failed'"), "unextracted", "path", F.lit(""))
    cause = F.create_map(*[F.lit(x) for kv in UNJUDGED.items() for x in kv])[F.coalesce("extraction_notice", F.lit(""))]
    unjudged = _finding(docs.withColumn("_c", cause).filter("_c is not null"), "unjudged", "path", F.col("_c"))
    bare = _finding(docs.filter(F.col("extraction_notice") == UNEVIDENCED), "unevidenced", "path", F.lit(""))
    return failed.unionByName(unjudged).unionByName(bare)


def membership(closures: DataFrame) -> DataFrame:
    """id, n_sources, root of documents inside sources' closures (source, id)."""
    return closures.filter("source <> id").groupBy("id").agg(F.count_distinct("source").alias("n_sources"), F.min("source").alias("root"))


def below_source(closures: DataFrame, levels: DataFrame) -> DataFrame:
    """Members of exactly one source's closure whose level is below the source's. levels: id, level (0..2)."""
    one = membership(closures).filter("n_sources = 1")
    own = levels.select("id", F.col("level").alias("own"))
    src = levels.select(F.col("id").alias("root"), F.col("level").alias("src"))
    return _finding(one.join(own, "id").join(src, "root").filter("own < src"), "below-source-sensitivity", "id", F.concat_ws(" ", "root", level_of(F.col("src"))))


def multi_source(provenance: DataFrame, closures: DataFrame, levels: DataFrame) -> DataFrame:
    """Documents that cite, aren't in exactly one closure, cite only known documents and are below the highest of these."""
    single = membership(closures).filter("n_sources = 1").select(F.col("id").alias("child"))
    cited = provenance.select("child", "parent").distinct().join(levels.select(F.col("id").alias("parent"), F.col("level").alias("p")), "parent", "left")
    high = cited.groupBy("child").agg(F.max("p").alias("high"), F.count_if(F.col("p").isNull()).alias("unknown")).filter("unknown = 0")
    out = high.join(single, "child", "left_anti").join(levels.select(F.col("id").alias("child"), F.col("level").alias("own")), "child").filter("own < high")
    return _finding(out, "multi-source-uncovered", "child", level_of(F.col("high")))


def conformance(docs: DataFrame) -> DataFrame:
    """Documents that don't parse, have no type, or hold invalid relations."""
    a = _finding(docs.filter("parse_error is not null or read_error is not null"), "unparsable", "path", F.coalesce("parse_error", "read_error"))
    b = _finding(docs.filter("parse_error is null and read_error is null and trim(coalesce(type, '')) = ''"), "no-type", "path", F.lit(""))
    c = _finding(docs.filter("not coalesce(relations_valid, true)"), "invalid-relations", "path", F.lit(""))
    return a.unionByName(b).unionByName(c)


def names(docs: DataFrame) -> DataFrame:
    """Names that aren't in composed form, and markdown under .state/."""
    from cairn.functions.text_udfs import nfc

    a = _finding(docs.filter(F.col("path") != nfc(F.col("path"))), "non-nfc-name", "path", F.lit(""))
    b = _finding(docs.filter(r"path like '.state/%.md' or path like '%/.state/%.md'"), "state-markdown", "path", F.lit(""))
    return a.unionByName(b)


def parse_window(docs: DataFrame, column: str, default: int) -> DataFrame:
    """docs with days and whether the default had to stand in."""
    days = window_days(F.col(column))
    return docs.withColumn("days", F.coalesce(days, F.lit(default))).withColumn("defaulted", days.isNull())


def collect(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, notices) of a bundle's rows: docs that can be checked, with path their id; (path, reason) of those that are passed over."""
    reason = (
        F.when(F.col("read_error").isNotNull(), "unreadable")
        .when(F.col("parse_error").isNotNull(), "unparseable frontmatter")
        .when(~F.coalesce("relations_valid", F.lit(True)), "invalid relations")
        .when(~F.coalesce("provenance_valid", F.lit(True)), "invalid provenance")
    )
    marked = concepts.withColumn("_reason", reason)
    docs = marked.filter("_reason is null").drop("_reason").withColumn("path", F.col("concept_id"))
    notices = marked.filter("_reason is not null").select(F.concat("concept_id", F.lit(".md")).alias("path"), F.col("_reason").alias("reason"))
    return docs, notices


def report(concepts: DataFrame, references: DataFrame, today: str, type_tiers: dict[str, str] | None = None) -> DataFrame:
    """(kind, path, detail, remediation): the findings of every check over a bundle's rows, and a skip for each document that can't be checked.

    references (source_id, null for the index, target_id): links of bodies and index. remediation is the command that resolves a finding, for
    the one kind that has it: documents that no single source covers, raised to the highest level they cite.
    """
    from cairn.operators.fixpoint import closures
    from cairn.sources.bundle import provenance_of, relations_of

    docs, notices = collect(concepts)
    relations = relations_of(docs.filter("relations is not null"))
    cited = provenance_of(docs)
    prov = cited.join(docs.select(F.col("concept_id").alias("child"), "resource"), "child")
    sources = docs.filter("type = 'Source'").select(F.col("concept_id").alias("source"), F.col("concept_id").alias("id"))
    covered = closures(cited, sources)
    levels = docs.select(F.col("concept_id").alias("id"), rank(F.col("sensitivity")).alias("level"))
    bodies = references.join(docs.select(F.col("concept_id").alias("source_id")), "source_id", "left_semi").unionByName(references.filter("source_id is null"))
    checks = [
        stale_stamps(window_for(docs, type_tiers), today),
        orphans(docs, bodies),
        dangling(docs, bodies.filter("source_id is not null").unionByName(relations.select("source_id", "target_id"))),
        status_findings(docs.filter("type = 'Source'")),
        below_source(covered, levels),
        multi_source(cited, covered, levels),
        dangling_provenance(docs, prov),
        unbacked(relations, cited),
        names(concepts.select("path")),
        notices.select(F.lit("skipped").alias("kind"), "path", F.col("reason").alias("detail")),
    ]
    found = checks[0]
    for x in checks[1:]:
        found = found.unionByName(x)
    command = F.when(F.col("kind") == "multi-source-uncovered", F.concat_ws(" ", F.lit("set-sensitivity"), "path", "detail"))
    return found.withColumn("remediation", F.coalesce(command, F.lit("")))

"""Derived and durable state: manifests, change capture, findings, decisions, ledgers, catalogue and log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def manifest_hash(docs: DataFrame) -> DataFrame:
    """One row: SHA-256 over `id \\0 sha256(content) \\n` of all documents by id.

    The concatenation is a whole-table value; it is built from one short line a document.
    """
    line = F.concat(F.col("concept_id"), F.lit("\0"), F.sha2(F.coalesce("body", F.lit("")), 256), F.lit("\n"))
    return docs.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("concept_id", line.alias("l")))), lambda x: x["l"]), ""), 256).alias("manifest"))


def classify(docs: DataFrame, stored: DataFrame, force: bool = False, same_model: bool = True, walk_errors: bool = False) -> DataFrame:
    """(concept_id, action) of a reindex: hit, embed or prune; nothing is pruned after a walk with errors."""
    now = docs.select("concept_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("now"))
    held = stored.select("concept_id", F.col("content_hash").alias("was"))
    hit = F.col("now").eqNullSafe(F.col("was")) & F.lit(same_model and not force)
    action = F.when(F.col("now").isNull(), F.lit("keep" if walk_errors else "prune")).when(hit, "hit").otherwise("embed")
    return now.join(held, "concept_id", "full_outer").select("concept_id", action.alias("action"))


def gate(force: bool, stored: str | None, current: str) -> bool:
    """Whether a derived store is rebuilt."""
    return force or stored != current


def stale(findings: DataFrame, current: DataFrame) -> DataFrame:
    """findings with stale: some input's current digest exists and differs; an input that is gone doesn't make it stale.

    findings: id, input_digests array of (ref, digest). current: ref, digest.
    """
    each = findings.select("id", F.explode("input_digests").alias("d")).select("id", F.col("d.ref").alias("ref"), F.col("d.digest").alias("was"))
    bad = each.join(current, "ref").groupBy("id").agg(F.max(F.col("digest") != F.col("was")).alias("stale"))
    return findings.join(bad, "id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


def supersede(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row with the largest id of each key."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("id")))
    return rows.withColumn("_n", place).filter("_n = 1").drop("_n")


def forget(store: DataFrame, ids: DataFrame, column: str = "concept_id") -> DataFrame:
    return store.join(ids.select(F.col("concept_id").alias(column)), column, "left_anti")


def recent_log(log: DataFrame, n: int) -> DataFrame:
    """The n newest entries: by date descending, then position."""
    return log.orderBy(F.desc("date"), "pos").limit(n)


def catalogue(entries: DataFrame) -> DataFrame:
    """(section, body): one rendered section per type, in registry order, lines by title."""
    from cairn.vocabulary import OBJECT_TYPES

    order = F.create_map(*[F.lit(x) for i, t in enumerate(OBJECT_TYPES) for x in (t[0], i)])
    name = F.create_map(*[F.lit(x) for t in OBJECT_TYPES for x in (t[0], t[2])])
    line = F.concat(F.lit("- ["), "title", F.lit("](/"), "concept_id", F.lit(".md)"))
    known = entries.filter(order[F.col("type")].isNotNull())
    groups = known.groupBy(order[F.col("type")].alias("place"), name[F.col("type")].alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "concept_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return groups.orderBy("place").select("place", "section", "body")


def unwind(ledger: DataFrame, survivor: str, target: str) -> DataFrame:
    """Entries to undo, newest first, down to the last that absorbed the target."""
    own = ledger.filter(F.col("survivor_id") == survivor)
    down_to = own.filter(F.col("absorbed_id") == target).agg(F.max("seq").alias("m"))
    return own.join(F.broadcast(down_to), F.col("seq") >= F.col("m")).drop("m").orderBy(F.desc("seq"))  # down_to is one row


def nesting_violations(ledger: DataFrame) -> DataFrame:
    """Entries whose embedded history isn't exactly the entries before."""
    before = F.collect_list("absorbed_id").over(W.partitionBy("survivor_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return ledger.withColumn("_b", before).filter(F.col("history") != F.col("_b")).select("survivor_id", "seq")


def torn_writes(pending: DataFrame, current: DataFrame) -> DataFrame:
    """(survivor_id, action): roll-forward where the survivor already has the pending hash, else roll-back."""
    at = current.select(F.col("concept_id").alias("survivor_id"), "content_hash")
    done = F.col("content_hash").eqNullSafe(F.col("expected_hash"))
    return pending.join(at, "survivor_id", "left").select("survivor_id", F.when(done, "roll-forward").otherwise("roll-back").alias("action"))


def collisions(files: DataFrame) -> DataFrame:
    """Base names that several files share: such a batch is refused."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.groupBy(name.alias("basename")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def slugs(titles: DataFrame) -> DataFrame:
    """titles (id, title) with slug: create-only names, later ones with -2, -3, ... by id."""
    base = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), F.lit("-"))
    n = F.row_number().over(W.partitionBy("_s").orderBy("id"))
    out = titles.withColumn("_s", base).withColumn("_n", n)
    return out.withColumn("slug", F.when(F.col("_n") == 1, F.col("_s")).otherwise(F.concat_ws("-", "_s", F.col("_n")))).drop("_s", "_n")

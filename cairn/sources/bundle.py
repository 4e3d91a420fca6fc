"""Reading and writing bundles: directories of markdown documents with YAML front matter."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = ("index.md", "log.md")
SCHEMA = (
    "concept_id string, path string, type string, title string, description string, resource string, tags array<string>, timestamp string, status string, "
    "version int, volatility string, freshness string, sensitivity string, provenance array<string>, relations array<struct<target: string, type: string>>, relations_valid boolean, provenance_valid boolean, "
    "type_alternative string, extraction_status string, extraction_notice string, origin_key string, body string, read_error string, parse_error string, "
    "content_hash string, extra map<string, string>"
)
_COLUMNS = [x.split()[0] for x in re.sub("<[^>]*>+", "", SCHEMA).split(", ")]
_TEXT = ("type", "title", "description", "resource", "timestamp", "status", "volatility", "freshness", "sensitivity", "type_alternative", "extraction_status", "extraction_notice", "origin_key")


def concept_id(path: str) -> str:
    """The path without .md, composed."""
    return unicodedata.normalize("NFC", path.removesuffix(".md"))


def _text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else x.isoformat() if hasattr(x, "isoformat") else str(x)


def parse(path: str, data: bytes) -> dict:
    """One scan row; what can't be read or parsed becomes a row with an error, never an exception."""
    import hashlib

    row = dict.fromkeys(_COLUMNS)
    row |= {"concept_id": concept_id(path), "path": path, "content_hash": hashlib.sha256(data).hexdigest(), "relations_valid": True, "provenance_valid": True}
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        return row | {"read_error": str(e)}
    lines = text.split("\n")
    if lines[0].rstrip() != "---" or "---" not in [x.rstrip() for x in lines[1:]]:
        return row | {"parse_error": "no front matter", "body": text}
    end = next(i for i, x in enumerate(lines[1:], 1) if x.rstrip() == "---")
    body = "\n".join(lines[end + 1 :])
    try:
        head = yaml.safe_load("\n".join(lines[1:end])) or {}
        if not isinstance(head, dict):
            raise yaml.YAMLError("front matter is no mapping")
    except yaml.YAMLError as e:
        return row | {"parse_error": str(e).split("\n")[0], "body": body}
    row |= {k: _text(head.get(k)) for k in _TEXT}
    row["version"] = head.get("version") if isinstance(head.get("version"), int) else None
    row["tags"] = [str(t) for t in head["tags"]] if isinstance(head.get("tags"), list) else None
    given = head.get("provenance")
    row["provenance"] = [str(p) for p in given] if isinstance(given, list) else None
    row["provenance_valid"] = given is None or isinstance(given, list)
    rel = head.get("relations")
    if rel is not None:
        ok = isinstance(rel, list) and all(isinstance(r, dict) and isinstance(r.get("target"), str) and isinstance(r.get("type"), str) for r in rel)
        row["relations_valid"] = ok
        row["relations"] = [{"target": r["target"], "type": r["type"]} for r in rel] if ok else None
    known = {*_TEXT, "version", "tags", "provenance", "relations"}
    row["extra"] = {str(k): str(v) for k, v in head.items() if k not in known}
    return row | {"body": body}


def read_bundle(spark: SparkSession, root: str) -> DataFrame:
    """All markdown documents under root but index.md and log.md, one row each. Files are read by Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    files = files.filter(~F.regexp_extract("path", r"([^/]+)$", 1).isin(*RESERVED))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import unquote

        for batch in batches:
            rows = [parse(unquote(p).split(base, 1)[-1].lstrip("/"), bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_raw(spark: SparkSession, pattern: str, extensions: tuple[str, ...] = ("md", "txt", "text", "markdown")) -> DataFrame:
    """(path, text) of raw text files with an allowed extension."""
    out = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return out.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def relations_of(concepts: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type) of valid relations; targets without .md."""
    one = concepts.filter("relations_valid").select(F.col("concept_id").alias("source_id"), F.explode("relations").alias("r"))
    return one.select("source_id", F.regexp_replace("r.target", r"\.md$", "").alias("target_id"), F.col("r.type").alias("relation_type"))


def provenance_of(concepts: DataFrame) -> DataFrame:
    """(child, parent), .md taken off."""
    return concepts.select(F.col("concept_id").alias("child"), F.explode("provenance").alias("p")).select("child", F.regexp_replace("p", r"\.md$", "").alias("parent"))


def embed_text(concepts: DataFrame) -> DataFrame:
    """(concept_id, text): title, description, tags and body, blank ones left out, by empty lines."""
    blank = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    tags = F.when(F.size("tags") > 0, F.array_join("tags", " "))
    return concepts.select("concept_id", F.concat_ws("\n\n", blank(F.col("title")), blank(F.col("description")), tags, blank(F.col("body"))).alias("text"))


def render(head: dict, body: str) -> str:
    """A document's text: keys in the given order, empty ones left out."""
    kept = {k: v for k, v in head.items() if v not in (None, [], {})}
    return f"---\n{yaml.safe_dump(kept, sort_keys=False, allow_unicode=True)}---\n{body}"


def build(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of (type, title, description, body, slug): rejects carry the reason."""
    from cairn.vocabulary import OBJECT_TYPES

    dirs = F.create_map(*[F.lit(x) for t in OBJECT_TYPES if t[0] != "Source" for x in (t[0], t[1])])
    reason = (
        F.when(dirs[F.coalesce("type", F.lit(""))].isNull(), "type")
        .when(F.trim(F.coalesce("title", F.lit(""))) == "", "title")
        .when(F.col("title").contains("\n") | F.col("description").contains("\n"), "newline")
        .when(F.trim(F.coalesce("description", F.lit(""))) == "", "description")
    )
    marked = objects.withColumn("reason", reason)
    good = marked.filter("reason is null").withColumn("concept_id", F.concat_ws("/", dirs[F.col("type")], F.col("slug"))).drop("reason")
    return good, marked.filter("reason is not null")

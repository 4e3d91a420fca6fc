"""The engine's relations over the driver's tables. Each adapter is one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ADAPTERS = {
    "concepts": """
SELECT concat('documents/', CAST(d.doc_id AS VARCHAR(20))) AS concept_id, split_part(d.text, chr(10), 1) AS title, d.text AS body,
  CASE CAST(substr(d.source, 4) AS INT) % 4 WHEN 0 THEN 'Concept' WHEN 1 THEN 'Person' WHEN 2 THEN 'Decision' ELSE 'Source' END AS type,
  CASE WHEN CAST(substr(d.source, 4) AS INT) % 5 = 0 THEN 'Person' END AS type_alternative,
  CASE WHEN l.quality = 0 THEN 'deprecated' ELSE 'active' END AS status,
  CASE WHEN l.toxic = 1 THEN 'confidential' WHEN l.toxic = 0 THEN 'private' END AS sensitivity, d.doc_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "provenance": """
SELECT doc_id AS child, CAST(floor(doc_id / 2) AS BIGINT) AS parent FROM documents WHERE doc_id >= 1
UNION SELECT doc_id AS child, CAST(floor(doc_id / 3) AS BIGINT) AS parent FROM documents WHERE doc_id >= 1""",
    "relations": """
SELECT concat('nation/', CAST(n_nationkey AS VARCHAR(20))) AS source_id, concat('region/', CAST(n_regionkey AS VARCHAR(20))) AS target_id, 'part_of' AS relation_type FROM nation
UNION ALL SELECT concat('customer/', CAST(c_custkey AS VARCHAR(20))), concat('nation/', CAST(c_nationkey AS VARCHAR(20))), 'member_of' FROM customer
UNION ALL SELECT concat('orders/', CAST(o_orderkey AS VARCHAR(20))), concat('customer/', CAST(o_custkey AS VARCHAR(20))), 'depends_on' FROM orders
UNION ALL SELECT DISTINCT concat('part/', CAST(l_partkey AS VARCHAR(20))), concat('orders/', CAST(l_orderkey AS VARCHAR(20))), 'derived_from' FROM lineitem
UNION ALL SELECT concat('documents/', CAST(doc_id AS VARCHAR(20))), concat('documents/', CAST(doc_id - 1 AS VARCHAR(20))), 'supersedes' FROM documents WHERE doc_id % 10 = 3""",
    "links": """
SELECT DISTINCT concat('part/', CAST(l_partkey AS VARCHAR(20))) AS source_id, concat('supplier/', CAST(l_suppkey AS VARCHAR(20))) AS target_id FROM lineitem
UNION SELECT concat('part/', CAST(l_partkey AS VARCHAR(20))), concat('orders/', CAST(l_orderkey AS VARCHAR(20))) FROM lineitem WHERE l_linenumber = 1""",
    "nodes": """
SELECT concat('nation/', CAST(n_nationkey AS VARCHAR(20))) AS concept_id FROM nation
UNION ALL SELECT concat('region/', CAST(r_regionkey AS VARCHAR(20))) FROM region
UNION ALL SELECT concat('customer/', CAST(c_custkey AS VARCHAR(20))) FROM customer
UNION ALL SELECT concat('supplier/', CAST(s_suppkey AS VARCHAR(20))) FROM supplier
UNION ALL SELECT concat('part/', CAST(p_partkey AS VARCHAR(20))) FROM part
UNION ALL SELECT concat('orders/', CAST(o_orderkey AS VARCHAR(20))) FROM orders WHERE o_orderkey % 7 <> 0""",
    "mirror": """
SELECT DISTINCT concat('part/', CAST(l_partkey AS VARCHAR(20))) AS child, concat('orders/', CAST(l_orderkey AS VARCHAR(20))) AS parent FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 2 = 0""",
    "vectors": "SELECT concat('vec/', CAST(vec_id AS VARCHAR(20))) AS concept_id, embedding, vec_id FROM embeddings",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter as a DataFrame; no view of the session's is touched."""
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", ADAPTERS[name].replace("VARCHAR(20)", "STRING"))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


def with_adapters(*names: str) -> str:
    """The adapters as the head of a WITH clause for DuckDB."""
    return ", ".join(f"{n} AS ({ADAPTERS[n]})" for n in names)

"""Registered queries against their DuckDB equivalents at the smallest size, and the plans that matter."""

import os

import duckdb
import pytest

from cairn.plans import catalogue
from cairn.sources.adapters import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUICK = ["bm25_topk", "phrase_match", "knn_l2", "neighbors_topk", "retrieval_pool_filter_fuse", "graph_edges", "contradiction_budget", "closure_all", "exact_title_groups", "stale_stamps", "dangling_targets", "content_hash_cdc", "union_merge", "judge_admission"]


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(v[i], 6) if isinstance(v[i], float) else v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(catalogue.oracle_sql()[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    df = catalogue.queries()[name](spark, SF)
    assert rows(df.columns, df.collect()) == want


def test_every_query_is_known():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_they_need(spark):
    plan = catalogue.survey_by_type(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]

"""Every catalogue query against its SQL on the same tables."""

import duckdb
import pytest

from ledgerline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return round(x, 9) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in got.collect())
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = con.execute(catalogue.ORACLES[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == names
    at = [order.index(c) for c in names]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["item_id", "rank", "doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["metadata_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
    plan = catalogue.QUERIES["filtered_vector_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "WindowGroupLimit" in plan


def _scans(spark, name, table):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # A reused exchange is listed by reference and not scanned again.
    return plan.count(f"{SF}/{table}.parquet")


@pytest.mark.parametrize(
    "name,table,most",
    [("bm25_candidates", "documents", 1), ("rrf_fusion", "documents", 1), ("hybrid_search", "documents", 1), ("mmr_rerank", "documents", 1), ("prompt_context", "documents", 1), ("position_changes", "lineitem", 1), ("ownership_summary", "lineitem", 1), ("fund_topn", "lineitem", 1), ("vector_topk", "embeddings", 2), ("eval_hit_mrr", "embeddings", 4)],
)
def test_tables_are_scanned_once(spark, name, table, most):
    assert 1 <= _scans(spark, name, table) <= most


@pytest.mark.parametrize("name", ["dashboard_run", "dashboard_rows", "rule_signals", "dcf_range", "thesis_scaffold", "snapshot_store", "holdings_index_counts", "holdings_index_errors"])
def test_shared_results_are_computed_once(spark, name):
    """What several parts of a plan go on from is a table by then, so the plan itself reads no line item again."""
    assert _scans(spark, name, "lineitem") <= 1


def test_ingest_reads_its_rows_once(spark):
    assert _scans(spark, "ingest_job", "orders") == 1


@pytest.mark.parametrize("name", ["ingest_job", "fact_extraction"])
def test_extraction_is_compiled(spark, name):
    """The JVM compiles no method of over 8,000 bytes and interprets it row by row."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
        stages = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) <= 8000


def test_index_recall_on_the_table(spark):
    got = catalogue.QUERIES["vector_index_topk"](spark, SF).groupBy("query_id").agg({"recall": "first", "*": "count"}).collect()
    assert len(got) == 10 and all(r["count(1)"] == 20 for r in got)
    assert sum(r["first(recall)"] for r in got) / len(got) >= 0.9

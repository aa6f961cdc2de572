from datetime import datetime, timezone

import pytest
from compare import rows
from test_ledger import change, ledger

from stratiform.operators import conformance as C
from stratiform.operators import governance as G
from stratiform.sources import inventory
from stratiform.sources.tables import create_table
from stratiform.specs import METADATA_KPIS


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(
        [
            ("c", "s", "full", "MANAGED", "text"),
            ("c", "s", "part", "VIEW", ""),
            ("c", "s", "none", "MANAGED", None),
            ("c", "s", "bare", "MANAGED", None),
            ("c", "information_schema", "tables", "VIEW", "text"),
            ("other", "s", "full", "MANAGED", "text"),
        ],
        inventory.TABLES,
    )


@pytest.fixture(scope="module")
def columns(spark):
    def column(table, name, comment, catalog="c"):
        return (catalog, "s", table, name, 1, "int", comment)

    return spark.createDataFrame(
        [
            column("full", "a", "x"), column("full", "b", "y"), column("part", "a", "x"), column("part", "b", ""),
            column("none", "a", None), column("full", "a", "x", "other"),
        ],
        inventory.COLUMNS,
    )


def test_coverage(spark, tables, columns):
    r = G.coverage(tables, columns, {"c": []}).first()
    assert r.asDict() == {
        "total_tables": 4, "tables_with_desc": 1, "tables_all_cols_desc": 1, "tables_partial_cols_desc": 1,
        "tables_no_cols_desc": 2,
    }
    assert G.coverage(tables, columns).first().total_tables == 5


def test_coverage_of_nothing(spark, tables, columns):
    lines = rows(G.coverage_rows(G.coverage(tables, columns, {"absent": []})))
    assert lines == [
        ("tables_all_cols_desc", 0, 0.0), ("tables_partial_cols_desc", 0, 0.0), ("tables_with_desc", 0, 0.0),
        ("total_tables", 0, None),
    ]


def test_leaderboards_break_ties_by_name(spark):
    df = ledger(
        spark,
        *[change(i, "rejected", user=u, reviewer="rob@x.example") for i, u in enumerate(["d", "c", "b", "a", "a@x.example"])],
        change(9, "approved", user="z", reviewer="rob"),
        change(10, user="z"),
    )
    boards = {}
    for r in G.leaderboards(df).collect():
        boards.setdefault(r.metric_name, {})[r.user_rank] = (r.user_id, r.user_count)
    assert boards == {
        "top_suggestor": {1: ("a", 2), 2: ("z", 2), 3: ("b", 1)},
        "top_reviewer": {1: ("rob", 6)},
        "top_rejected_suggestor": {1: ("a", 2), 2: ("b", 1), 3: ("c", 1)},
    }


def test_cache(spark, tables, columns, audit_ts):
    spark.sql("CREATE DATABASE IF NOT EXISTS kpis")
    create_table(spark, METADATA_KPIS, "kpis.cache")
    df = ledger(spark, change(1, "rejected", reviewer="rob"))
    for _ in range(2):
        cache = G.kpi_cache(tables, columns, df, audit_ts, {"c": []})
        G.refresh_cache(cache, "kpis.cache")
    stored = spark.table("kpis.cache")
    assert stored.columns == METADATA_KPIS.columns and stored.count() == 7
    assert dict(rows(G.cached_metrics(stored)))["total_tables"] == 4
    assert rows(G.cached_board(stored, G.REVIEWERS)) == [("rob", 1, 1)]
    assert G.cache_listing(stored).first().metric_name == "tables_all_cols_desc"
    assert G.last_refresh(stored).first()[0] == datetime(2025, 1, 1, tzinfo=timezone.utc).replace(tzinfo=None)


@pytest.mark.parametrize(
    ("name", "good"),
    [
        ("bronze_transactions", True),
        ("bronze_date_dimensions", True),
        ("gold_category_performance", True),
        ("RawTransactions", False),
        ("BRONZE_TRANSACTIONS", False),
        ("transactions", False),
        ("gold-sales-summary", False),
        ("goldDailySales", False),
        ("bronze_", False),
    ],
)
def test_names(spark, name, good):
    tables = spark.createDataFrame([("c", "s", name, "MANAGED", "x")], inventory.TABLES)
    columns = spark.createDataFrame([("c", "s", name, "a", 1, "int", None)], inventory.COLUMNS)
    passed = {r.rule: r.passed for r in C.table_conformance(tables, columns).collect()}
    assert passed["name"] is good


def test_conformance(spark):
    full = {"quality": "silver", C.CHANGE_FEED: "true", C.ROW_TRACKING: "true"}
    tables = spark.createDataFrame(
        [
            ("c", "s", "silver_a", "STREAMING_TABLE", "x", full, 2),
            ("c", "s", "silver_b", "MANAGED", None, {**full, C.ROW_TRACKING: "false"}, 0),
            ("c", "s", "gold_c", "MATERIALIZED_VIEW", "x", {"quality": "gold", C.CHANGE_FEED: "true"}, 1),
            ("c", "s", "gold_d", "MATERIALIZED_VIEW", "x", None, None),
        ],
        inventory.TABLES + ", properties map<string,string>, rule_count int",
    )
    order = ["id", "data_quality_flag", "audit_ts", "source_system"]
    listed = [("silver_a", order), ("silver_b", ["id", "source_system", "audit_ts"]), ("gold_c", ["audit_ts", "source_system", "id"])]
    columns = spark.createDataFrame(
        [("c", "s", t, n, i, "string", None) for t, names in listed for i, n in enumerate(names)], inventory.COLUMNS
    )
    sources = spark.createDataFrame(
        [("c", "s", "silver_a", "silver_transformation"), ("c", "s", "gold_c", "gold_aggregation"), ("c", "s", "gold_c", "pos")],
        "table_catalog string, table_schema string, table_name string, source_system string",
    )
    failed = {}
    for r in C.conformance(tables, columns, sources).filter("not passed").collect():
        failed.setdefault(r.table_name, set()).add(r.rule)
    assert failed == {
        "silver_b": {"comment", "audit_columns_last", "properties", "kind", "quality_flag"},
        "gold_c": {"audit_columns_last", "rules_in_silver_only", "source_system"},
        "gold_d": {"audit_columns_last", "properties"},
    }

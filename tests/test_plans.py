"""Physical plans: what the queries must and must not do at scale."""

import io
import re
from contextlib import redirect_stdout

import pytest
from compare import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__ as register
from stratiform.operators.quality import Rule, apply_rules
from stratiform.plans import inputs as src
from stratiform.session import setting

QUERIES = {n: q for n, q in register.queries().items() if n not in register.LLM_QUERIES}
# these write tables before they return
WRITTEN = {n for n in QUERIES if "stream" in n or "load" in n} | {
    "keyed_update", "fail_rule_report", "users_rolled_up", "csv_export", "ledger_append", "kpi_listing", "kpi_metrics", "kpi_board",
}


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan(q(spark, SF_DIR)) for n, q in QUERIES.items() if n not in WRITTEN}


def test_no_product_join_and_no_python(plans):
    for name, text in plans.items():
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
            assert node not in text, (name, node)


def test_scans_read_needed_columns_only(plans):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plans["sales_by_department_season"])
    read = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert read == {"l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "p_partkey", "p_brand"}


def test_key_filter_reaches_the_scan(plans):
    assert "IsNotNull(o_orderkey)" in plans["bronze_copy"].split("PushedFilters")[1]


def test_drop_rules_reach_the_scan(spark):
    orders = src.table(spark, SF_DIR, "orders")
    text = plan(apply_rules(orders, [Rule("open", "o_orderstatus = 'O'"), Rule("big", "o_totalprice >= 1000")]))
    assert "EqualTo(o_orderstatus,O)" in text and "GreaterThanOrEqual(o_totalprice,1000.0)" in text


def test_rank_is_limited_before_the_shuffle(plans):
    for name in ("ledger_best", "ledger_overlay", "leaderboards"):
        assert re.search(r"WindowGroupLimit.*\n|WindowGroupLimit", plans[name]), name
        assert "Partial" in plans[name], name


def test_kpis_scan_each_input_once(plans):
    """Tables from orders; columns from lines and orders; the ledger once for all three boards."""
    assert len(re.findall(r"^\(\d+\) Scan parquet", plans["metadata_kpis"], re.M)) == 4


def test_sales_meet_their_dimensions_once(plans):
    """Both distinct counts and all sums come from one pass over the joined sales."""
    for name in ("category_performance", "retail_performance"):
        assert len(re.findall(r"^\(\d+\) Scan parquet .*\n.*\[(?=[^\n]*l_orderkey)", plans[name], re.M)) == 1, name


@pytest.fixture
def sales(spark, tmp_path):
    """A folder of 20,000 sales lines with their orders, articles and stores, some keys null and some twice."""
    n = F.col("id")
    lines = {"l_orderkey": F.when(n % 97 > 0, n % 5000), "l_linenumber": n.cast("int"), "l_partkey": n % 400, "l_suppkey": n % 50}
    lines |= {"l_quantity": n % 7 + 1.0, "l_extendedprice": n * 1.25 + 1, "l_discount": n % 5 / 100, "l_tax": n % 3 / 100}
    lines["l_shipdate"] = F.expr("timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, cast(id % 10 as int))")
    types = F.when(n % 9 > 0, F.concat(F.lit("type "), n % 3))
    part = {"p_partkey": n, "p_name": F.lit("green apple"), "p_brand": F.concat(F.lit("b"), n % 2), "p_type": types, "p_retailprice": n + 0.5}
    tables = {
        "lineitem": (20_000, lines),
        "orders": (5_000, {"o_orderkey": n, "o_custkey": n % 300, "o_orderpriority": F.when(n % 2 > 0, "2-HIGH").otherwise("5-LOW")}),
        "part": (400, part),
        "supplier": (51, {"s_suppkey": n % 50, "s_name": F.concat(F.lit("s"), n), "s_nationkey": (n % 5).cast("int")}),
        "nation": (5, {"n_nationkey": n.cast("int"), "n_name": F.lit("x"), "n_regionkey": (n % 2).cast("int")}),
        "region": (2, {"r_regionkey": n.cast("int"), "r_name": F.when(n > 0, "north")}),
    }
    for name, (rows, columns) in tables.items():
        spark.range(rows, numPartitions=1).select(*[c.alias(k) for k, c in columns.items()]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_sales_lines_are_not_shuffled_for_a_small_dimension(spark, sales):
    """Stores smaller than the threshold are broadcast, whatever the product of the dimensions' sizes."""
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "20000"):
        text = plan(src.transactions(spark, sales))
    assert "hashpartitioning(l_orderkey" in text and "hashpartitioning(l_suppkey" not in text


def test_checked_summary_shuffles_its_lines_once(spark, sales):
    """The summaries by sketches and by exact counts read the lines of a group from one exchange and meet without another."""
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        checked = QUERIES["category_performance_approx"](spark, sales)
        found = checked.collect()
        text = checked._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        exact = QUERIES["category_performance"](spark, sales).drop("unique_customers", "revenue_per_customer")
        assert checked.drop("unique_customers_close").exceptAll(exact).isEmpty() and len(found) == exact.count()
    assert "ReusedExchange" in text and len(re.findall(r"FileScan parquet \[l_orderkey", text)) == 1
    assert len(re.findall(r"(?<!, )Exchange hashpartitioning\([^\n]*sale_date", text)) == 1
    keys = ["sale_date", "department", "category", "subcategory", "region", "sales_channel"]
    assert {r.unique_customers_close for r in found if None not in [r[k] for k in keys]} == {True}
    assert {r.unique_customers_close for r in found if None in [r[k] for k in keys]} == {False}


def test_elements_of_arrays_are_not_copied(plans):
    assert "Expand" not in plans["exploded_metrics"] and len(re.findall(r"^\(\d+\) Generate", plans["exploded_metrics"], re.M)) == 1


def test_changes_are_parsed_once(plans):
    assert plans["cdc_valid"].count("Generate") >= 2
    assert len(re.findall(r"from_json\(StructField\(op", plans["cdc_valid"])) <= 4


def test_first_submission_combines_before_the_shuffle(plans):
    assert "partial_min_by" in plans["ledger_submit"]
    assert "partial_max_by" in plans["scd1_current"]


def test_history_is_one_plan_for_every_key(plans):
    """Whole rows are shuffled twice: to merge copies of (key, sequence), and to their slices."""
    assert plans["scd2_history"].count("Exchange hashpartitioning") == plans["scd2_hot_key"].count("Exchange hashpartitioning")
    for name in ("scd2_history", "scd2_hot_key", "scd2_collapsed"):
        assert "Join" not in plans[name] and "Broadcast" not in plans[name], name

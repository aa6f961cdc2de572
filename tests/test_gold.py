from datetime import date, datetime

import pytest
from compare import rows
from pyspark.sql import functions as F

from stratiform.functions.measures import cast_failed, exact_sum, is_true, recent, share_pct, tried
from stratiform.operators import gold
from stratiform.operators.calendar import date_dimension, days_between
from stratiform.plans.queries import QUERIES

TX = (
    "transaction_id string, article_id string, transaction_date date, date_key bigint, quantity bigint, "
    "net_amount double, total_amount double, region string, sales_channel string, customer_id string"
)
DAY = date(2025, 7, 16)


def tx(spark, *lines):
    return spark.createDataFrame(list(lines), TX)


def articles(spark):
    return spark.createDataFrame(
        [("a", "food", "fruit", "apple", 1.0), ("b", "food", "fruit", "pear", 2.0)],
        "article_id string, department string, category string, subcategory string, base_cost double",
    )


def calendar(spark):
    return date_dimension(days_between(spark, DAY, DAY))


def test_exact_sum_does_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e9, -1e9, -0.6, 1.123456, -2.5]
    for order in (values, values[::-1]):
        df = spark.createDataFrame([(v,) for v in order], "v double")
        assert str(df.agg(exact_sum(F.col("v"))).first()[0]) == "-1.376544"
    many = spark.range(100000).select(F.lit(9e12).alias("v"))
    assert many.agg(exact_sum(F.col("v"))).first()[0] == 9 * 10**17
    assert spark.createDataFrame([], "v double").agg(exact_sum(F.col("v"))).first()[0] is None


def test_category_performance(spark, audit_ts):
    df = tx(
        spark,
        ("t1", "a", DAY, 20250716, 2, 10.0, 12.0, "N", "store", "c1"),
        ("t1", "a", DAY, 20250716, 1, 5.0, 6.0, "N", "store", "c1"),
        ("t2", "a", DAY, 20250716, 1, 5.0, 6.0, "N", "store", None),
        ("t3", "zz", DAY, 20250716, 1, 5.0, 6.0, "N", "store", "c9"),
    )
    for approximate in (False, True):
        r = gold.category_performance(df, articles(spark), audit_ts, approximate=approximate).collect()
        assert len(r) == 1
        r = r[0]
        assert (r.transaction_count, r.total_units_sold, r.unique_customers) == (2, 4, 1)
        assert (r.gross_revenue, r.net_revenue, r.avg_transaction_value) == (24.0, 20.0, 8.0)
        assert (r.gross_profit, r.profit_margin_pct) == (16.0, 80.0)
        assert (r.units_per_transaction, r.revenue_per_customer) == (2.0, 20.0)


def test_sales_lines_are_shuffled_once(spark, audit_ts):
    """Nulls, repeats and a transaction of two customers are counted without a copy of a line."""
    line = lambda t, c, total: (t, "a", DAY, 20250716, 1, 1.0, total, "N", "store", c)
    df = tx(spark, line("t1", "c1", 1.0), line("t1", "c2", 2.0), line("t1", "c2", None), line(None, "c1", 4.0), line(None, None, 8.0), line("t2", None, 1.0))
    for approximate in (False, True):
        out = gold.category_performance(df, articles(spark), audit_ts, approximate=approximate)
        r = out.first()
        assert (r.transaction_count, r.unique_customers, r.total_units_sold, r.gross_revenue, r.avg_transaction_value) == (2, 2, 6, 16.0, 3.2)
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in text and text.count("Exchange hashpartitioning(sale_date") == 1


@pytest.mark.parametrize("ahead", [1, 2, 100])
def test_lookup_joins_later_facts_only_when_it_must(spark, ahead):
    known = articles(spark).unionByName(articles(spark).filter("article_id = 'b'"))
    lines = [(f"t{i:02}", "ab"[i % 2] if i > 6 else "none", DAY, 1, 1, 1.0, float(i % 3), "N", "s", "c") for i in range(20)]
    facts = tx(spark, *lines)
    want = [(r.transaction_id, r.subcategory) for r in facts.join(known, "article_id").orderBy("transaction_id", "total_amount").limit(4).collect()]
    got = gold.article_lookup(facts, known, ["transaction_id", "total_amount"], 4, ahead)
    assert [(r.transaction_id, r.subcategory) for r in got.collect()] == want and want[0][0] == "t07"
    assert gold.article_lookup(facts, known.limit(0), ["transaction_id"], 4, ahead).count() == 0
    # the first facts are taken before they are joined
    assert got._jdf.queryExecution().optimizedPlan().toString().count("GlobalLimit") >= 2


def test_performance_bands(spark, audit_ts):
    def band(total):
        df = tx(spark, ("t", "a", DAY, 20250716, 1, 0.0, total, "N", "store", "c"))
        return gold.retail_performance(df, articles(spark), calendar(spark), audit_ts).first()

    assert band(0.5).performance_indicator == "LOSS"
    assert band(1.05).performance_indicator == "LOW_MARGIN"
    assert band(1.25).performance_indicator == "NORMAL"
    assert band(2.0).performance_indicator == "HIGH_MARGIN"
    assert band(0.0).performance_indicator == "LOSS" and band(0.0).profit_margin_pct is None


def test_zero_revenue_and_cost_is_normal(spark, audit_ts):
    free = articles(spark).withColumn("base_cost", F.lit(0.0))
    df = tx(spark, ("t", "a", DAY, 20250716, 1, 0.0, 0.0, "N", "store", "c"))
    assert gold.retail_performance(df, free, calendar(spark), audit_ts).first().performance_indicator == "NORMAL"


def test_season_report_is_ordered(spark):
    df = tx(
        spark,
        ("t1", "a", DAY, 20250716, 1, 0.0, 1.0, "N", "store", "c"),
        ("t2", "b", DAY, 20250716, 1, 0.0, 5.0, "N", "store", "c"),
    )
    split = articles(spark).withColumn("department", F.col("article_id"))
    out = gold.sales_by_season(df, split, calendar(spark)).collect()
    assert [(r.department, r.retail_season, r.transaction_count, r.total_revenue) for r in out] == [
        ("b", "Summer", 1, 5.0),
        ("a", "Summer", 1, 1.0),
    ]


def test_join_on_the_date_itself(spark):
    df = tx(spark, ("t1", "a", DAY, 20250716, 1, 0.0, 1.0, "N", "store", "c"))
    days = calendar(spark).select(F.col("full_date").alias("transaction_date"), "retail_season")
    assert gold.star_join(df, calendar=days, calendar_key="transaction_date").first().retail_season == "Summer"
    gone = days.limit(0)
    assert gold.star_join(df, calendar=gone, calendar_key="transaction_date").count() == 0
    assert gold.star_join(df, calendar=gone, calendar_key="transaction_date", how="left").count() == 1


def test_totals_keep_entities_without_facts(spark):
    people = spark.createDataFrame([(1,), (2,)], "id int")
    facts = spark.createDataFrame([(1, 1.5), (1, 2.0)], "who int, amount double")
    assert rows(gold.totals_per_entity(people, "id", facts, "who", "amount")) == [(1, 2, 3.5), (2, 0, 0.0)]


def test_repeated_element_counts_key_once(spark):
    df = spark.createDataFrame(
        [(1, "x", 10.0, ["a", "a", None], "en"), (2, "x", 5.0, ["a"], "de"), (3, "x", 1.0, [], "en"), (4, "x", 1.0, None, "en")],
        "id int, dim string, amount double, tags array<string>, lang string",
    )
    for unique in (False, True):
        out = gold.exploded_metrics(df, "id", "dim", "amount", "tags", "tag", "row", "lang", unique)
        assert rows(out) == [("a", "x", 2, 25.0, 8.33, ["de", "en"]), (None, "x", 1, 10.0, 10.0, ["en"])]
        out = gold.exploded_metrics(df, "id", "dim", "amount", "tags", "tag", "row", key_is_unique=unique)
        assert rows(out) == [("a", "x", 2, 25.0, 8.33), (None, "x", 1, 10.0, 10.0)]
    twice = gold.exploded_metrics(df.unionByName(df), "id", "dim", "amount", "tags", "tag", "row")
    assert rows(twice)[0][2] == 2
    other = df.unionByName(df.withColumn("lang", F.lit("fr")))
    assert [r[2] for r in rows(gold.exploded_metrics(other, "id", "dim", "amount", "tags", "tag", "row", "lang"))] == [2, 1]
    with pytest.raises(Exception, match="id is not unique"):
        gold.exploded_metrics(other, "id", "dim", "amount", "tags", "tag", "row", key_is_unique=True).collect()


def test_flow_performance(spark, audit_ts):
    origin = ("p", "f", "d", "u1")
    when = datetime(2024, 2, 1, 12)
    log = spark.createDataFrame(
        [
            (when, "INFO", "flow_progress", '{"duration_ms": 60000}', origin),
            (when, "INFO", "flow_progress", '{"duration_ms": "n/a"}', origin),
            (when, "INFO", "other", '{"duration_ms": 999999}', origin),
            *[(when, "ERROR", "other", "{}", origin)] * 3,
            (datetime(2023, 12, 1), "ERROR", "other", "{}", origin),
        ],
        "timestamp timestamp, level string, event_type string, details string, "
        "origin struct<pipeline_name:string, flow_name:string, dataset_name:string, update_id:string>",
    )
    r = gold.flow_performance(log, date(2024, 2, 10), audit_ts).collect()
    assert len(r) == 1
    assert (r[0].event_count, r[0].update_count, r[0].avg_duration_minutes, r[0].error_count, r[0].health_status) == (
        6, 1, 1.0, 3, "RED",
    )
    assert r[0].source_system == "event_log"


@pytest.mark.parametrize("places", [0, 2, 6, 9])
def test_exact_sum_of_any_places(spark, places):
    values = [0.1, 0.2, -0.3, 1e9 + 0.123456789, -2.5, None]
    df = spark.createDataFrame([(v,) for v in values * 50], "v double")
    total = df.agg(exact_sum(F.col("v"), places)).first()[0]
    assert float(total) == pytest.approx(sum(round(v, places) for v in values if v is not None) * 50, abs=50 * 10.0**-places)
    assert df.repartition(7).agg(exact_sum(F.col("v"), places)).first()[0] == total
    with pytest.raises(ValueError):
        exact_sum(F.col("v"), 10)


def test_small_expressions(spark):
    df = spark.createDataFrame([(0, 0), (1, 4)], "a int, b int")
    assert [r[0] for r in df.select(share_pct(F.col("a"), F.col("b"))).collect()] == [0.0, 25.0]
    days = spark.createDataFrame([(date(2024, 1, 11),), (date(2024, 1, 10),)], "d date")
    assert days.filter(recent(F.col("d"), F.lit(date(2024, 2, 10)), 30)).count() == 1


def test_flags_and_casts(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    out = df.select(tried("v", "int"), cast_failed("v", "int").alias("bad"), is_true(F.col("v") == "1").alias("one"))
    assert [tuple(r) for r in out.collect()] == [(1, False, True), (None, True, False), (None, False, False)]


def test_reports_keep_sales_of_any_day(spark, sf_dir, tmp_path):
    """Sales lines of 1989 and 2031 are in both reports."""
    for name in ("orders", "part", "supplier", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    odd = F.when(F.col("l_orderkey") % 3 == 0, F.lit("1989-05-06")).when(F.col("l_orderkey") % 3 == 1, F.lit("2031-07-08"))
    kind = lines.schema["l_shipdate"].dataType
    lines.withColumn("l_shipdate", F.coalesce(odd.cast(kind), "l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    units, n = lines.agg(F.sum(F.col("l_quantity").cast("bigint")), F.count("*")).first()
    assert QUERIES["retail_performance"](spark, str(tmp_path)).agg(F.sum("total_units_sold")).first()[0] == units
    assert QUERIES["sales_by_department_season"](spark, str(tmp_path)).agg(F.sum("transaction_count")).first()[0] == n

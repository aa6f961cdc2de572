import pytest
from compare import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from stratiform.operators.bronze import bronze, order_columns, with_audit
from stratiform.operators.quality import (
    Rule,
    apply_rules,
    key_report,
    null_report,
    orphan_report,
    quality_flag,
    refine,
    rule_report,
    split_rows,
)
from stratiform.operators.silver import silver_articles


def test_null_is_a_violation(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "amount int")
    assert rows(apply_rules(df, [Rule("positive", "amount >= 0")])) == [(1,)]


def test_fail_rule_raises_even_under_count(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id int, v string")
    checked = apply_rules(df, [Rule("has_id", "id IS NOT NULL", "fail")])
    with pytest.raises(Exception, match="has_id"):
        checked.select("v").count()


def test_fail_is_tested_before_drop(spark):
    df = spark.createDataFrame([(None, -5)], "id int, amount int")
    both = [Rule("amount", "amount >= 0"), Rule("has_id", "id IS NOT NULL", "fail")]
    with pytest.raises(Exception, match="has_id"):
        apply_rules(df, both).count()
    assert apply_rules(df, both[:1]).count() == 0


def test_clean_rows_pass_a_fail_rule(spark):
    df = spark.createDataFrame([(1, 2), (2, -2)], "id int, amount int")
    both = [Rule("amount", "amount >= 0"), Rule("has_id", "id IS NOT NULL", "fail")]
    assert rows(apply_rules(df, both)) == [(1, 2)]


def test_rules_name_their_side(spark):
    df = spark.createDataFrame([("Active ",), ("gone",)], "status string")
    out = [F.upper(F.trim("status")).alias("status")]
    assert rows(refine(df, out, [Rule("s", "status = 'ACTIVE'")])) == [("ACTIVE",)]
    assert rows(refine(df, out, [Rule("s", "status = 'Active '", on="input")])) == [("ACTIVE",)]
    assert rows(refine(df, out, [Rule("s", "status = 'ACTIVE'", on="input")])) == []


def test_observation_counts_violations(spark):
    seen = Observation("rules")
    df = spark.createDataFrame([(1,), (-1,), (None,)], "amount int")
    apply_rules(df, [Rule("positive", "amount >= 0")], seen).collect()
    assert seen.get == {"rows": 3, "positive": 2}


def test_rule_report_on_empty_input(spark):
    df = spark.createDataFrame([], "amount int")
    assert rows(rule_report(df, [Rule("positive", "amount >= 0")])) == [("positive", "drop", 0, 0)]


def test_first_flag_wins(spark):
    df = spark.createDataFrame([(None, -1), (1, -1), (1, 1)], "a int, b int")
    flag = quality_flag([("MISSING_A", F.col("a").isNull()), ("NEGATIVE_B", F.col("b") < 0)])
    assert [r[0] for r in df.select(flag).collect()] == ["MISSING_A", "NEGATIVE_B", "CLEAN"]


def test_split_is_the_whole_input(spark):
    df = spark.createDataFrame([(1, None), (2, "bad")], "id int, reason string")
    valid, rejected = split_rows(df, "reason")
    assert rows(valid) == [(1,)] and rows(rejected) == [(2, "bad")]


def test_key_report(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    assert rows(key_report(df, ["id"])) == [(1, 2, "DUPLICATE_KEY"), (None, 1, "NULL_KEY")]


def test_orphans_leave_null_out(spark):
    fact = spark.createDataFrame([(1,), (9,), (9,), (None,)], "fk int")
    dim = spark.createDataFrame([(1,)], "pk int")
    assert rows(orphan_report(fact, "fk", dim, "pk")) == [(9, 2)]


def test_null_report(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert rows(null_report(df, ["a", "b"])) == [("a", 1, 2), ("b", 2, 2)]


def test_status_survives_normalising(spark, audit_ts):
    raw = spark.createDataFrame(
        [(" 1 ", "food", "x y", "z", "Active", "1.0", "2.0"), ("2", "food", "x", "z", "retired", "1.0", "2.0")],
        "article_id string, department string, category string, subcategory string, status string, "
        "base_cost string, list_price string",
    )
    out = silver_articles(raw, audit_ts).collect()
    assert [(r.article_id, r.department, r.category, r.status, r.profit_margin, r.margin_percentage) for r in out] == [
        ("1", "Food", "X Y", "ACTIVE", 1.0, 50.0)
    ]


def test_zero_price_has_no_margin_percentage(spark, audit_ts):
    raw = spark.createDataFrame(
        [("1", "f", "c", "s", "active", "0.0", "0.0")],
        "article_id string, department string, category string, subcategory string, status string, "
        "base_cost string, list_price string",
    )
    assert silver_articles(raw, audit_ts).first().margin_percentage is None


def test_bronze_keeps_columns_and_ends_with_audit(spark, audit_ts):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id int, v string")
    out = bronze(df, ["id"], audit_ts, "pos")
    assert out.columns == ["id", "v", "audit_ts", "source_system"]
    assert out.count() == 1


def test_source_file_comes_before_audit(spark, audit_ts, tmp_path):
    spark.range(3).write.json(str(tmp_path / "in"))
    out = bronze(spark.read.json(str(tmp_path / "in")), ["id"], audit_ts, "pos", source_file=True)
    assert out.columns == ["id", "_source_file", "audit_ts", "source_system"]
    assert out.filter(~F.contains("_source_file", F.lit("in/part-"))).count() == 0


def test_column_order(spark, audit_ts):
    df = with_audit(spark.createDataFrame([(1, 2, 3, 4)], "flag int, m int, k int, other int"), audit_ts, "pos")
    assert order_columns(df, keys=["k"], measures=["m"], flags=["flag"]).columns == [
        "k", "other", "m", "flag", "audit_ts", "source_system",
    ]

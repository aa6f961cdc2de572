"""Inputs of the operators, derived from the driver's tables by Spark.

All rows are kept; states such as "pending" or "no key" follow from ids by arithmetic, so that SQL can
derive the same inputs.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.functions.measures import date_key
from stratiform.functions.text import COLUMN_FORMAT, TABLE_FORMAT, asset_kind
from stratiform.operators.calendar import date_dimension, days_of
from stratiform.operators.quality import quality_flag

AUDIT_TS = datetime(2025, 1, 1, tzinfo=timezone.utc)
SUBMITTED_AT = datetime(2024, 6, 1, tzinfo=timezone.utc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(value: Column) -> Column:
    return value.cast("string")


# Star schema


def transactions(
    spark: SparkSession, sf_dir: str, with_order: bool = True, with_store: bool = True
) -> DataFrame:
    """Sales lines. The order gives customer and channel, the supplier the store; both can be left out."""
    rows = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    day = F.col("l_shipdate").cast("date")
    columns = [
        F.concat_ws(
            "-",
            text(F.col("l_orderkey")),
            text(F.col("l_linenumber")),
            text(F.col("l_partkey")),
            text(F.col("l_suppkey")),
            text(date_key(day)),
            text(F.rint(F.col("l_extendedprice") * F.lit(100.0)).cast("bigint")),
        ).alias("transaction_id"),
        text(F.col("l_orderkey")).alias("basket_id"),
        text(F.col("l_partkey")).alias("article_id"),
        day.alias("transaction_date"),
        date_key(day).alias("date_key"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.rint(F.col("l_discount") * F.lit(100.0)).cast("bigint").alias("discount_pct"),
        net.alias("net_amount"),
        (net * (F.lit(1.0) + F.col("l_tax"))).alias("total_amount"),
    ]
    if with_order:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if with_store:
        # one table a join, each of the size of its file: a chain of dimensions joined first counts as their product
        stores = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        rows = (
            rows.join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        columns += [
            text(F.col("l_suppkey")).alias("store_id"),
            F.col("s_name").alias("store_name"),
            F.col("r_name").alias("region"),
            F.when(F.col("s_nationkey") % 2 == 0, "superstore").otherwise("local").alias("store_type"),
        ]
    if with_order:
        urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        columns += [
            F.when(urgent, "online").otherwise("store").alias("sales_channel"),
            text(F.col("o_custkey")).alias("customer_id"),
        ]
    return rows.select(*columns)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        text(F.col("p_partkey")).alias("article_id"),
        F.col("p_name").alias("article_name"),
        F.col("p_brand").alias("department"),
        F.col("p_type").alias("category"),
        F.substring_index("p_name", " ", -1).alias("subcategory"),
        (F.col("p_retailprice") * F.lit(0.8)).alias("base_cost"),
        F.col("p_retailprice").alias("list_price"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days the sales lines span."""
    return date_dimension(days_of(table(spark, sf_dir, "lineitem"), F.col("l_shipdate")))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as they might arrive: padded ids, mixed case, text numbers, missing values."""
    size = F.col("p_size")
    cost = (F.col("p_retailprice") * F.when(size % 11 == 0, 1.1).otherwise(0.8)).cast("decimal(18,2)")
    status = (
        F.when(size % 6 == 0, "Active")
        .when(size % 6 == 1, " blocked ")
        .when(size % 6 == 2, "PENDING")
        .when(size % 6 == 3, "Discontinued")
        .when(size % 6 == 4, "retired")
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), text(F.col("p_partkey")), F.lit("  ")).alias("article_id"),
        F.lower("p_brand").alias("department"),
        F.concat(F.lit(" "), "p_type").alias("category"),
        F.upper("p_name").alias("subcategory"),
        status.alias("status"),
        F.when(size % 13 == 0, "n/a").when(size % 17 != 0, text(cost)).alias("base_cost"),
        text(F.col("p_retailprice").cast("decimal(18,2)")).alias("list_price"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines with text quantities, some missing, and some negative prices."""
    rows = transactions(spark, sf_dir, with_order=False, with_store=False)
    line = F.col("quantity") + F.col("discount_pct")
    return rows.select(
        F.concat(F.lit(" "), "transaction_id").alias("transaction_id"),
        F.concat("article_id", F.lit(" ")).alias("article_id"),
        F.when(line % 19 != 0, text(F.col("quantity"))).alias("quantity"),
        F.when(line % 23 == 0, -F.col("unit_price")).otherwise(F.col("unit_price")).alias("unit_price"),
        "total_amount",
    )


# Lines of CSV files, with values that the declared types refuse


def _day_text(day: Column) -> Column:
    return F.date_format(day, "dd-MM-yyyy")


def transaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines as text: some quantities are words, some dates have another form."""
    rows = transactions(spark, sf_dir).drop("date_key", "net_amount")
    order, part = F.col("basket_id").cast("bigint"), F.col("article_id").cast("bigint")
    return rows.withColumns(
        {
            "quantity": F.when(order % 101 == 0, "many").otherwise(text(F.col("quantity"))),
            "transaction_date": F.when(part % 103 == 0, text(F.col("transaction_date"))).otherwise(
                _day_text(F.col("transaction_date"))
            ),
        }
    )


def article_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as text with all declared columns: some weights, days and lead times don't parse."""
    number, size = F.col("p_partkey"), F.col("p_size")
    first_day = F.date_add(F.lit("2020-01-01").cast("date"), size)
    values = {
        "article_id": text(number),
        "status": F.when(size % 2 == 0, "ACTIVE").otherwise("BLOCKED"),
        "valid_from": F.when(number % 61 == 0, "soon").otherwise(text(first_day)),
        "valid_to": F.when(size % 3 == 0, text(F.date_add(first_day, 365))),
        "lifecycle_group": F.when(size % 5 != 0, "core"),
        "department": F.col("p_brand"),
        "category": F.col("p_type"),
        "subcategory": F.substring_index("p_name", " ", -1),
        "brand": F.col("p_brand"),
        "article_name": F.concat(F.col("p_name"), F.lit(', "'), text(size), F.lit('"')),
        "short_description": F.lit(None).cast("string"),
        "supplier_id": text(number % 100),
        "supplier_name": F.concat(F.lit("Supplier "), text(number % 100)),
        "country_of_origin": F.lit("GB"),
        "base_uom": F.lit("EA"),
        "net_content": F.concat(text(size), F.lit(" g")),
        "net_weight_kg": F.when(number % 53 == 0, "heavy").otherwise(text(size / F.lit(8.0))),
        "base_cost": text(F.col("p_retailprice") * F.lit(0.8)),
        "list_price": text(F.col("p_retailprice")),
        "tax_rate_pct": F.lit("20.0"),
        "discountable": F.lit("Y"),
        "in_stores": F.lit("Y"),
        "in_ecommerce": F.when(size % 4 == 0, "Y").otherwise("N"),
        "distribution_center_id": text(size % 6),
        "distribution_center_name": F.concat(F.lit("DC "), text(size % 6)),
        "replenishment_type": F.lit("daily"),
        "lead_time_days": F.when(number % 59 == 0, "1.5").otherwise(text(size % 7)),
    }
    return table(spark, sf_dir, "part").select(*[v.alias(n) for n, v in values.items()])


def calendar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of the sales lines as text; on each thirteenth the week is a word, on leap days the date has another form."""
    days = date_dimension(days_of(table(spark, sf_dir, "lineitem"), F.col("l_shipdate")), iso_year_week=True)
    leap = (F.col("month_number") == 2) & (F.col("day_of_month") == 29)
    return days.withColumns(
        {
            "full_date": F.when(leap, text(F.col("full_date"))).otherwise(_day_text(F.col("full_date"))),
            "week_of_year": F.when(F.col("day_of_month") == 13, "none").otherwise(text(F.col("week_of_year"))),
        }
    )


# Change events


PAYLOAD = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def _operation() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", "c").when(kind == "purchase", "r").when(kind == "error", "d").otherwise("u")
    )


def change_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events as JSON text, with missing keys, bad operations, wrong types and unknown fields."""
    number = F.col("event_id")
    op = F.when(number % 83 == 0, None).when(number % 89 == 0, "x").otherwise(_operation())
    key = F.when(number % 97 != 0, F.col("user_id"))
    fields = [key.alias("user_id"), "event_id", F.col("event_type").alias("kind")]
    image = (
        F.when(number % 101 == 0, F.to_json(F.struct(*fields, F.lit("n/a").alias("value"))))
        .when(number % 103 == 0, F.to_json(F.struct(*fields, "value", F.lit(1).alias("extra"))))
        .otherwise(F.to_json(F.struct(*fields, "value")))
    )
    events = table(spark, sf_dir, "events").select(
        op.alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), image.alias("image")
    )
    gone = F.coalesce(F.col("op") == "d", F.lit(False))
    line = F.concat(
        F.lit("{"),
        F.coalesce(F.concat(F.lit('"op":"'), "op", F.lit('",')), F.lit("")),
        F.lit('"ts_ms":'),
        text(F.col("ms")),
        F.lit(',"before":'),
        F.when(gone, F.col("image")).otherwise("null"),
        F.lit(',"after":'),
        F.when(gone, "null").otherwise(F.col("image")),
        F.lit("}"),
    )
    return events.select(line.alias("value"))


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid change events as rows: payload, operation, event time in milliseconds."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.col("event_type").alias("kind"),
        "value",
        _operation().alias("cdc_operation"),
        F.timestamp_millis(F.unix_millis(ts)).alias("cdc_timestamp"),
    )


CHANGE_ROW = T.StructType(
    [
        *PAYLOAD.fields,
        T.StructField("cdc_operation", T.StringType()),
        T.StructField("cdc_timestamp", T.TimestampType()),
    ]
)


# Events as measures and as an event log


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, some without a key."""
    number = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(number % 97 != 0, F.col("user_id")).alias("user_id"),
        "event_id",
        "event_type",
        "value",
        F.col("ts").cast("timestamp").alias("ts"),
    )


def measured_events(events: DataFrame) -> DataFrame:
    user = F.col("user_id")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(user % 2 == 0, "web").otherwise("app").alias("channel"),
        F.when(user % 3 == 0, "gold").otherwise("basic").alias("tier"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("quantity"),
        quality_flag([("LOW_VALUE", F.col("value") < 5.0)]),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    progress = kind.isin("click", "view", "purchase")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"),
        F.when(progress, "flow_progress").otherwise(kind).alias("event_type"),
        F.concat(
            F.lit('{"duration_ms": '),
            text(F.get_json_object("props", "$.k").cast("bigint") * 1000),
            F.lit("}"),
        ).alias("details"),
        F.struct(
            F.concat(F.lit("line_"), text(F.col("user_id") % 5)).alias("pipeline_name"),
            F.concat(F.lit("flow_"), text(F.col("user_id") % 3)).alias("flow_name"),
            F.concat(F.lit("set_"), text(F.col("user_id") % 7)).alias("dataset_name"),
            text(F.floor(F.col("event_id") / 10)).alias("update_id"),
        ).alias("origin"),
    )


# Inventory and ledger: one table per order, one column per order line


def asset_names(number: Column) -> list[Column]:
    prefix = (
        F.when(number % 4 == 0, "bronze_t_")
        .when(number % 4 == 1, "silver_t_")
        .when(number % 4 == 2, "gold_t_")
        .otherwise("Orders-")
    )
    schema = F.when(number % 50 == 7, F.lit("information_schema")).otherwise(
        F.concat(F.lit("sch_"), text(number % 5))
    )
    return [F.concat(F.lit("cat_"), text(number % 3)), schema, F.concat(prefix, text(number))]


def _table_names(number: Column) -> list[Column]:
    catalog, schema, name = asset_names(number)
    return [catalog.alias("table_catalog"), schema.alias("table_schema"), name.alias("table_name")]


def _table_type(number: Column) -> Column:
    return (
        F.when(number % 5 == 0, "MANAGED")
        .when(number % 5 == 1, "VIEW")
        .when(number % 5 == 2, "MATERIALIZED_VIEW")
        .when(number % 5 == 3, "STREAMING_TABLE")
        .otherwise("EXTERNAL")
    )


def inv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_orderkey")
    comment = F.when(number % 3 == 0, None).when(number % 3 == 1, "")
    layer = (
        F.when(number % 4 == 0, "bronze").when(number % 4 == 1, "silver").when(number % 4 == 2, "gold").otherwise("raw")
    )
    properties = F.create_map(
        F.lit("quality"),
        layer,
        F.lit("delta.enableChangeDataFeed"),
        F.when(number % 6 == 0, "false").otherwise("true"),
        F.lit("delta.enableRowTracking"),
        F.when(number % 9 == 0, "false").otherwise("true"),
    )
    return table(spark, sf_dir, "orders").select(
        *_table_names(number),
        _table_type(number).alias("table_type"),
        F.when(number % 3 == 2, F.concat(F.lit("Orders by "), "o_orderpriority")).otherwise(comment).alias("comment"),
        properties.alias("properties"),
        (number % 2).cast("int").alias("rule_count"),
    )


def inv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as columns `col_1` ..., and the standard columns on every other table."""
    number, line = F.col("l_orderkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    state = (number + line) % 4
    listed = lines.select(
        *_table_names(number),
        F.concat(F.lit("col_"), text(line)).alias("column_name"),
        line.alias("ordinal"),
        F.lit("double").alias("data_type"),
        F.when(number % 5 == 0, "Measure")
        .when(state == 0, "")
        .when(state == 1, F.concat(F.lit("Line "), text(line)))
        .when(state == 2, "Measure")
        .alias("comment"),
    )
    number = F.col("o_orderkey")
    standard = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("ordinal"), F.lit(t).alias("data_type"))
            for n, i, t in (("data_quality_flag", 8, "string"), ("audit_ts", 9, "timestamp"), ("source_system", 10, "string"))
        ]
    )
    added = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", F.explode(F.when(number % 2 == 0, standard)).alias("c"))
        .select(*_table_names(number), "c.*", F.lit("Standard column").alias("comment"))
    )
    return listed.unionByName(added)


def observed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_orderkey")
    value = (
        F.when(number % 7 == 0, "other")
        .when(number % 4 == 0, "pos")
        .when(number % 4 == 1, "silver_transformation")
        .when(number % 4 == 2, "gold_aggregation")
    )
    return table(spark, sf_dir, "orders").select(*_table_names(number), value.alias("source_system"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per event; eight changes share an asset, so targets repeat."""
    number = F.col("event_id")
    asset_number = F.floor(number / 8)
    catalog, schema, asset = asset_names(asset_number)
    kind = F.col("event_type")
    on_table = number % 4 == 0
    change = F.when(number % 13 == 0, "delete").when(number % 13 == 1, "add new").otherwise("modify")
    words = F.when(number % 13 == 0, None).when(number % 11 == 0, "Orders by 5-LOW").when(number % 11 == 1, "Measure")
    status = (
        F.when(number % 211 == 0, "escalated")
        .when(kind == "view", "pending")
        .when(kind.isin("click", "purchase"), "approved")
        .otherwise("rejected")
    )
    events = table(spark, sf_dir, "events").withColumn("status", status)
    reviewed = F.col("status").isin("approved", "rejected")
    approved = F.col("status") == "approved"
    ts = F.col("ts").cast("timestamp")
    mail = F.lit("@corp.example")
    return events.select(
        ts.alias("suggestion_date"),
        F.concat(F.lit("user_"), text(F.col("user_id")), F.when(number % 2 == 0, mail).otherwise("")).alias("suggestor_id"),
        catalog.alias("catalog"),
        schema.alias("schema"),
        asset.alias("asset"),
        asset_kind(_table_type(asset_number)).alias("asset_type"),
        F.when(on_table, TABLE_FORMAT).otherwise(COLUMN_FORMAT).alias("suggestion_format"),
        F.when(on_table, asset).otherwise(F.concat(F.lit("col_"), text(number % 3 + 1))).alias("suggestion_on"),
        F.when((number % 13 != 0) & (number % 11 > 1), F.concat(F.lit("It's change "), text(number)))
        .otherwise(words)
        .alias("suggestion"),
        change.alias("suggestion_type"),
        F.col("status"),
        F.when(
            reviewed,
            F.concat(F.lit("reviewer_"), text(F.col("user_id") % 10), F.when(number % 5 == 0, mail).otherwise("")),
        ).alias("reviewer_id"),
        F.when(reviewed, ts + F.expr("interval 1 day")).alias("review_date"),
        F.when(reviewed & (number % 3 == 0), "looks fine").alias("reviewer_comments"),
        F.concat(F.lit("change_"), text(number)).alias("change_id"),
        F.when(approved & (number % 2 == 0), True).when(approved & (number % 5 == 0), False).alias("synced_to_uc"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn asks for a description on the asset of its conversation."""
    conv, turn = F.col("conv_id"), F.col("turn")
    catalog, schema, asset = asset_names(conv)
    return table(spark, sf_dir, "conversations").select(
        (conv * 2147483648 + turn).alias("request_id"),
        catalog.alias("catalog"),
        schema.alias("schema"),
        asset.alias("asset"),
        F.when(turn == 0, "table_comment").otherwise("column_comment").alias("change_type"),
        F.when(turn > 0, F.concat(F.lit("col_"), text(turn % 3 + 1))).alias("column_name"),
        F.when(turn % 3 == 0, " ").when(turn % 3 == 1, "Old text").alias("old_value"),
        F.when(turn % 5 == 4, " \n").otherwise(F.col("text")).alias("new_value"),
        F.concat(F.col("role"), F.lit("_"), text(conv % 7)).alias("suggestor_id"),
    )


def decisions(ledger_rows: DataFrame) -> DataFrame:
    """A decision on every pending change, and a second, later one on every reviewed change."""
    number = F.substring_index("change_id", "_", -1).cast("bigint")
    pending = F.col("status") == "pending"
    return ledger_rows.select(
        "change_id",
        F.when(number % 2 == 0, "approved").otherwise("rejected").alias("status"),
        F.concat(F.lit("lead_"), text(number % 4)).alias("reviewer_id"),
        (F.coalesce("review_date", "suggestion_date") + F.expr("interval 2 days")).alias("review_date"),
        F.when(pending, "first look").otherwise("second look").alias("reviewer_comments"),
    )

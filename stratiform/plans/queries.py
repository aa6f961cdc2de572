"""Registered queries: each operator over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stratiform.functions.measures import exact_sum, is_true
from stratiform.functions.sketches import is_close
from stratiform.functions.text import qualified_name
from stratiform.operators import cdc, conformance, gold, governance, history, ledger, quality, silver
from stratiform.operators.bronze import bronze, order_columns, with_audit, with_source_file
from stratiform.operators.calendar import date_dimension, days_of
from stratiform.plans import inputs as src
from stratiform.session import configure, setting, work_folder
from stratiform.sources.files import discard, export_csv, read_stream
from stratiform.sources.inventory import is_user_schema, list_schemas, list_tables
from stratiform.sources.tables import (
    RuleViolation,
    create_table,
    load_csv,
    row_counts,
    rows_with_ids,
    update_partitions,
    write_checked,
    write_files,
    write_table,
)
from stratiform.specs import AUDIT_COLUMNS, DATE_DIMENSIONS, METADATA_KPIS, RETAIL_ARTICLES, SUGGESTIONS, TRANSACTIONS_KEYED, TableSpec
from stratiform.streaming import ingest, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Register a function under its own name; a trailing underscore keeps it apart from an import."""

    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    QUERIES[run.__name__.rstrip("_")] = configured
    return run


# Raw layer


@query
def bronze_copy(spark, sf_dir):
    return bronze(src.table(spark, sf_dir, "orders"), ["o_orderkey"], src.AUDIT_TS, "ecommerce")


UNPARTITIONED = replace(TRANSACTIONS_KEYED, partition_by=())


@contextmanager
def _declared(spark: SparkSession, folder: str) -> Iterator[tuple[str, str]]:
    """Name and location of a declared table that is forgotten afterwards; its files stay."""
    name = f"loaded_{uuid.uuid4().hex}"
    try:
        yield name, f"{folder}/out"
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _csv(rows: DataFrame, spec: TableSpec, path: str) -> str:
    rows.write.options(header="true", dateFormat=spec.date_format, compression="gzip").csv(path)
    return path


def _loaded(spark: SparkSession, spec: TableSpec, lines: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Write lines as CSV files, load them into the declared table: its rows and the report of the load.

    Shuffles of the export are dropped when it ends, so that they don't lie beside those of the load, and the files once they are loaded.
    """
    folder = work_folder(spark, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        path = _csv(lines.select(*[c for c in spec.columns if c in lines.columns]), spec, f"{folder}/in")
        with _declared(spark, folder) as (name, location):
            report = load_csv(spark, spec, path, name, location)
            # as a table, since the rows of a partition value that is NULL lie in a folder of another name
            rows = spark.read.schema(spec.schema).parquet(location)
    discard(spark, path)
    return rows, report.withColumn("table_name", F.lit(spec.name))


@query
def typed_csv_load(spark, sf_dir):
    """Export the sales lines as CSV, load them into a table without partitions, report each day."""
    rows = src.transactions(spark, sf_dir)
    return (
        _loaded(spark, UNPARTITIONED, rows.drop("date_key"), "csv-load")[0]
        .groupBy("date_key")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("quantity").alias("units"),
            exact_sum(F.col("total_amount")).cast("double").alias("total_amount"),
        )
    )


@query
def load_transactions(spark, sf_dir):
    """Sales lines loaded into the declared table by day: values that don't parse are NULL, and so is the day that follows from a date."""
    return _loaded(spark, TRANSACTIONS_KEYED, src.transaction_lines(spark, sf_dir), "load-transactions")[0]


@query
def load_articles(spark, sf_dir):
    return _loaded(spark, RETAIL_ARTICLES, src.article_lines(spark, sf_dir), "load-articles")[0]


@query
def load_dates(spark, sf_dir):
    return _loaded(spark, DATE_DIMENSIONS, src.calendar_lines(spark, sf_dir), "load-dates")[0]


@query
def load_reports(spark, sf_dir):
    """Rows loaded and values refused, by table and column, counted while loading."""
    reports = [
        _loaded(spark, UNPARTITIONED, src.transaction_lines(spark, sf_dir), "report-transactions")[1],
        _loaded(spark, RETAIL_ARTICLES, src.article_lines(spark, sf_dir), "report-articles")[1],
        _loaded(spark, DATE_DIMENSIONS, src.calendar_lines(spark, sf_dir), "report-dates")[1],
    ]
    every = reduce(DataFrame.unionByName, reports)
    return every.select("table_name", "row_count", F.explode("rejects").alias("column_name", "rejected_count"))


def _stream_bronze(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    folder = work_folder(spark, f"{kind}-stream")
    events = src.keyed_events(spark, sf_dir)
    form = {} if kind == "parquet" else {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    header = {"header": "true"} if kind == "csv" else {}
    events.write.format(kind).options(**form, **header).save(f"{folder}/in")
    stream = read_stream(spark, kind, events.schema, f"{folder}/in", **form)
    raw = ingest.bronze_stream(stream, ["user_id"], src.AUDIT_TS, "ecommerce")
    ingest.append(raw, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _from_file(spark.read.parquet(f"{folder}/out"))


def _from_file(rows: DataFrame) -> DataFrame:
    """Provenance that can be compared: whether a row names a file of the folder it was read from."""
    return rows.withColumn("_source_file", F.contains("_source_file", F.lit("/in/part-")))


@query
def json_stream_bronze(spark, sf_dir):
    return _stream_bronze(spark, sf_dir, "json")


@query
def csv_stream_bronze(spark, sf_dir):
    return _stream_bronze(spark, sf_dir, "csv")


@query
def parquet_stream_bronze(spark, sf_dir):
    return _stream_bronze(spark, sf_dir, "parquet")


def _in_pieces(rows: DataFrame, path: str, number: str, start: Callable[[], StreamingQuery], pieces: int = 3) -> None:
    """Let rows arrive in pieces by a number, a start of the stream after each, all on one checkpoint.

    The pieces hold rows of all times, so each but the first is late in part.
    """
    for piece in range(pieces):
        rows.filter(F.col(number) % pieces == piece).write.mode("append").parquet(path)
        start().awaitTermination()


@query
def new_files_stream(spark, sf_dir):
    """Two starts of a stream on one checkpoint, a file a batch: each reads only what came since the one before."""
    folder = work_folder(spark, "new-files")
    events = src.keyed_events(spark, sf_dir)
    starts = iter((1, 2))

    def start() -> StreamingQuery:
        stream = read_stream(spark, "parquet", events.schema, f"{folder}/in", maxFilesPerTrigger="1")
        raw = ingest.bronze_stream(stream, ["user_id"], src.AUDIT_TS, "ecommerce").withColumn("start", F.lit(next(starts)))
        return ingest.append(raw, f"{folder}/out", f"{folder}/checkpoint")

    _in_pieces(events, f"{folder}/in", "event_id", start, pieces=2)
    return _from_file(spark.read.parquet(f"{folder}/out"))


@query
def late_rows_stream(spark, sf_dir):
    """Days closed by a watermark: rows that come after their day was closed are left out.

    A first start brings all rows but some of the first ten days, a second start those.
    """
    folder = work_folder(spark, "late-rows")
    late = (F.col("event_id") % 50 == 0) & (F.col("ts") < F.lit("2024-01-11").cast("timestamp"))
    events = src.keyed_events(spark, sf_dir).withColumn("late", late.cast("int"))

    def start() -> StreamingQuery:
        stream = read_stream(spark, "parquet", events.schema, f"{folder}/in")
        return ingest.append(ingest.closed_days(stream, "ts", "2 days"), f"{folder}/out", f"{folder}/checkpoint")

    _in_pieces(events, f"{folder}/in", "late", start, pieces=2)
    return spark.read.parquet(f"{folder}/out")


# Change events and history


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = cdc.parse_changes(src.change_lines(spark, sf_dir), src.PAYLOAD)
    return cdc.classify_changes(changes, ["user_id"])


@query
def cdc_valid(spark, sf_dir):
    return cdc.split_changes(_classified(spark, sf_dir), src.AUDIT_TS, "ecommerce")[0]


@query
def cdc_quarantine(spark, sf_dir):
    """Rejected changes. A value of the wrong type has no typed form, so the line itself is the evidence."""
    rejected = cdc.split_changes(_classified(spark, sf_dir), src.AUDIT_TS, "ecommerce")[1]
    return rejected.withColumn("_rescued_data", F.col("_rescued_data").isNotNull())


@query
def cdc_reason_counts(spark, sf_dir):
    return cdc.reason_counts(_classified(spark, sf_dir))


@query
def cdc_typed(spark, sf_dir):
    valid = cdc.split_changes(_classified(spark, sf_dir), src.AUDIT_TS, "ecommerce")[0]
    return cdc.typed_changes(valid, {"value": "decimal(18,2)", "kind": "string"}, keep_deletes=False)


@query
def quarantine_stream(spark, sf_dir):
    """Change lines as a text stream, split into two tables in one pass, counted per outcome."""
    folder = work_folder(spark, "quarantine")
    src.change_lines(spark, sf_dir).write.text(f"{folder}/in")
    lines = read_stream(spark, "text", T.StructType([T.StructField("value", T.StringType())]), f"{folder}/in")
    changes = cdc.parse_changes(lines, src.PAYLOAD)
    ingest.quarantine_stream(
        changes, f"{folder}/out", f"{folder}/checkpoint", ["user_id"], src.AUDIT_TS, "ecommerce"
    ).awaitTermination()
    valid = spark.read.parquet(f"{folder}/out/valid").select(F.lit(None).cast("string").alias("quarantine_reason"))
    rejected = spark.read.parquet(f"{folder}/out/rejected").select("quarantine_reason")
    return cdc.reason_counts(valid.unionByName(rejected))


@query
def quarantine_stream_rows(spark, sf_dir):
    """Both sides of the split, row by row, with the file each line came from and the event a rescued line tells of."""
    folder = work_folder(spark, "quarantine-rows")
    src.change_lines(spark, sf_dir).write.text(f"{folder}/in")
    lines = read_stream(spark, "text", T.StructType([T.StructField("value", T.StringType())]), f"{folder}/in")
    changes = cdc.parse_changes(with_source_file(lines), src.PAYLOAD)
    ingest.quarantine_stream(
        changes, f"{folder}/out", f"{folder}/checkpoint", ["user_id"], src.AUDIT_TS, "ecommerce"
    ).awaitTermination()
    valid = spark.read.parquet(f"{folder}/out/valid").withColumn("outcome", F.lit("VALID"))
    rejected = spark.read.parquet(f"{folder}/out/rejected").withColumnRenamed("quarantine_reason", "outcome")
    line = F.col("_rescued_data")
    image = F.coalesce(F.get_json_object(line, "$.after.event_id"), F.get_json_object(line, "$.before.event_id"))
    both = valid.unionByName(rejected, allowMissingColumns=True)
    return _from_file(both.withColumn("_rescued_data", image.cast("bigint"))).drop("batch")


@query
def scd1_current(spark, sf_dir):
    return history.scd1(src.change_rows(spark, sf_dir), ["user_id"], "cdc_timestamp", ["event_id"])


@query
def scd2_history(spark, sf_dir):
    return history.scd2(src.change_rows(spark, sf_dir), ["user_id"], "cdc_timestamp", ["event_id"])


@query
def scd2_collapsed(spark, sf_dir):
    changes = src.change_rows(spark, sf_dir).drop("value")
    return history.scd2(changes, ["user_id"], "cdc_timestamp", ["event_id"], collapse_unchanged=True)


@query
def scd2_hot_key(spark, sf_dir):
    """History where one key holds a third of the log."""
    rows = src.change_rows(spark, sf_dir)
    rows = rows.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    return history.scd2(rows, ["user_id"], "cdc_timestamp", ["event_id"])


@query
def scd1_stream(spark, sf_dir):
    """Current state kept over three starts of a stream, with late rows and rows before their delete."""
    folder = work_folder(spark, "scd1")
    by = (["user_id"], "cdc_timestamp", ["event_id"])

    def start() -> StreamingQuery:
        changes = read_stream(spark, "parquet", src.CHANGE_ROW, f"{folder}/in")
        return state.scd1_stream(changes, f"{folder}/out", f"{folder}/checkpoint", *by)

    _in_pieces(src.change_rows(spark, sf_dir), f"{folder}/in", "event_id", start)
    return state.scd1_state(spark, f"{folder}/out", src.CHANGE_ROW, *by)


@query
def scd2_stream(spark, sf_dir):
    """History kept over three starts of a stream, with late rows and rows before their delete."""
    folder = work_folder(spark, "scd2")
    by = (["user_id"], "cdc_timestamp", ["event_id"])

    def start() -> StreamingQuery:
        changes = read_stream(spark, "parquet", src.CHANGE_ROW, f"{folder}/in")
        return state.scd2_stream(changes, f"{folder}/out", f"{folder}/checkpoint", *by)

    _in_pieces(src.change_rows(spark, sf_dir), f"{folder}/in", "event_id", start)
    return state.scd2_state(spark, f"{folder}/out", src.CHANGE_ROW, *by)


@query
def change_feed(spark, sf_dir):
    old = src.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    raised = F.when(key % 10 == 0, F.col("c_acctbal") + 1.0).otherwise(F.col("c_acctbal"))
    kept = old.filter(key % 17 != 0).withColumn("c_acctbal", raised)
    added = old.withColumn("c_custkey", -key - 1)
    return cdc.change_feed(old, kept.unionByName(added), ["c_custkey"])


@query
def keyed_update(spark, sf_dir):
    """Orders kept by month; a keyed update of some orders before 1996 rewrites their months alone."""
    folder = work_folder(spark, "keyed-update")
    orders = src.table(spark, sf_dir, "orders")
    rows = orders.withColumn("order_month", F.date_trunc("MONTH", F.col("o_orderdate").cast("date")).cast("date"))
    write_files(rows, folder, ["order_month"])
    some = (F.col("o_orderkey") % 97 == 0) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    updates = orders.filter(some).select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1.0).alias("o_totalprice")
    )
    update_partitions(
        spark, folder, rows.schema, ["order_month"], updates, "o_orderkey", ["o_orderstatus", "o_totalprice"]
    )
    return spark.read.schema(rows.schema).parquet(folder)


# Tables


@query
def csv_export(spark, sf_dir):
    """Customers exported as CSV and read back by type."""
    folder = work_folder(spark, "export")
    rows = src.table(spark, sf_dir, "customer")
    export_csv(rows, folder)
    return spark.read.schema(rows.schema).option("header", "true").csv(folder)


@query
def ledger_append(spark, sf_dir):
    """A declared ledger table written anew, then appended to; its rows by suggestion type and status, counted."""
    folder = work_folder(spark, "ledger-append")
    with _declared(spark, folder) as (name, location):
        create_table(spark, SUGGESTIONS, name, location)
        rows = src.ledger(spark, sf_dir)
        for _ in range(2):
            write_table(rows, SUGGESTIONS, name)
        write_table(_submission(spark, sf_dir)[0], SUGGESTIONS, name, overwrite=False)
        counts = row_counts(spark, [name]).first().row_count
        kept = spark.read.schema(SUGGESTIONS.schema).parquet(location)
    by = kept.groupBy("suggestion_type", "status").agg(F.count(F.lit(1)).alias("row_count"))
    return by.withColumn("table_rows", F.lit(counts))


@query
def submitted_ids(spark, sf_dir):
    """Every submission has an id of its own, the same in every run."""
    runs = [_submission(spark, sf_dir)[0].select("change_id", F.lit(i).alias("run")) for i in range(2)]
    each = runs[0].unionByName(runs[1]).groupBy("change_id").agg(*[F.count_if(F.col("run") == i).alias(f"run_{i}") for i in range(2)])
    return each.agg(
        F.sum("run_0").alias("row_count"),
        F.count_if(F.col("run_0") > 0).alias("id_count"),
        F.count_if(F.col("run_0") != F.col("run_1")).alias("changed_ids"),
    )


@query
def pending_sync_view(spark, sf_dir):
    """Changes to be written, through the temporary view that a job of another step reads."""
    ledger.register_not_synced(src.ledger(spark, sf_dir), "pending_sync_rows")
    return spark.table("pending_sync_rows").groupBy("asset_type").agg(F.count(F.lit(1)).alias("row_count"))


@query
def ledger_of_assets(spark, sf_dir):
    """Ledger rows of given ids, repeated ids counting once."""
    rows = src.ledger(spark, sf_dir)
    ids = rows.filter(F.col("status") == "rejected").select("change_id")
    return rows_with_ids(rows, ids.unionByName(ids), "change_id")


@query
def reviewed_flags(spark, sf_dir):
    """Flags that are never NULL, in the standard order of columns."""
    rows = src.ledger(spark, sf_dir).select(
        "change_id", is_true(F.col("synced_to_uc")).alias("is_synced"), is_true(F.col("review_date") > F.col("suggestion_date")).alias("is_reviewed")
    )
    return order_columns(with_audit(rows, src.AUDIT_TS, "ledger"), keys=["change_id"], flags=["is_reviewed", "is_synced"])


# Validated layer and quality


@query
def silver_articles(spark, sf_dir):
    return silver.silver_articles(src.raw_articles(spark, sf_dir), src.AUDIT_TS)


@query
def silver_transactions(spark, sf_dir):
    return silver.silver_transactions(src.raw_transactions(spark, sf_dir), src.AUDIT_TS)


@query
def silver_transactions_stream(spark, sf_dir):
    """Raw files to a raw table to a validated table, both kept by streams."""
    folder = work_folder(spark, "silver-stream")
    rows = src.raw_transactions(spark, sf_dir)
    rows.write.parquet(f"{folder}/in")
    raw = read_stream(spark, "parquet", rows.schema, f"{folder}/in")
    raw = ingest.bronze_stream(raw, ["transaction_id", "article_id"], src.AUDIT_TS, "pos", source_file=False)
    ingest.append(raw, f"{folder}/bronze", f"{folder}/checkpoint-bronze").awaitTermination()
    upstream = read_stream(spark, "parquet", raw.schema, f"{folder}/bronze")
    checked = silver.silver_transactions(upstream, src.AUDIT_TS)
    ingest.append(checked, f"{folder}/silver", f"{folder}/checkpoint-silver").awaitTermination()
    return spark.read.parquet(f"{folder}/silver")


@query
def expectation_report(spark, sf_dir):
    columns = src.raw_transactions(spark, sf_dir).select(*silver.transaction_columns())
    return quality.rule_report(columns, silver.TRANSACTION_RULES)


@query
def fail_rule_report(spark, sf_dir):
    """A checked write, then one in which fail rules are broken: the rules named, and the rows the target still has."""
    target = f"{work_folder(spark, 'checked-write')}/target"
    rows = src.raw_transactions(spark, sf_dir).select(*silver.transaction_columns())
    write_checked(rows, silver.TRANSACTION_RULES, target)
    broken = rows.withColumn("transaction_id", F.when(F.col("quantity") != 7, F.col("transaction_id")))
    try:
        write_checked(broken, silver.TRANSACTION_RULES, target)
        violations = {}
    except RuleViolation as error:
        violations = error.violations
    report = spark.createDataFrame(list(violations.items()), "rule string, violations bigint")
    return report.withColumn("target_rows", F.lit(spark.read.parquet(target).count()))


@query
def quality_flag_counts(spark, sf_dir):
    columns = src.raw_transactions(spark, sf_dir).select(*silver.transaction_columns())
    return columns.groupBy("data_quality_flag").agg(F.count(F.lit(1)).alias("row_count"))


@query
def pk_violations(spark, sf_dir):
    return quality.key_report(src.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def fk_orphans(spark, sf_dir):
    stocked = src.table(spark, sf_dir, "part").filter(F.col("p_size") < 45)
    return quality.orphan_report(src.table(spark, sf_dir, "lineitem"), "l_partkey", stocked, "p_partkey")


@query
def not_null_report(spark, sf_dir):
    rows = src.raw_articles(spark, sf_dir)
    return quality.null_report(rows, rows.columns)


# Business layer


@query
def date_dimension_(spark, sf_dir):
    """Calendar of the days the facts span."""
    return date_dimension(
        days_of(src.table(spark, sf_dir, "lineitem"), F.col("l_shipdate")), iso_year_week=True
    )


@query
def sales_by_department_season(spark, sf_dir):
    facts = src.transactions(spark, sf_dir, with_order=False, with_store=False)
    return gold.sales_by_season(facts, src.articles(spark, sf_dir), src.calendar(spark, sf_dir))


@query
def retail_performance(spark, sf_dir):
    return gold.retail_performance(
        src.transactions(spark, sf_dir),
        src.articles(spark, sf_dir),
        src.calendar(spark, sf_dir),
        src.AUDIT_TS,
        approximate=False,
    )


@query
def category_performance(spark, sf_dir):
    return gold.category_performance(
        src.transactions(spark, sf_dir), src.articles(spark, sf_dir), src.AUDIT_TS, approximate=False
    )


def _checked(
    close: DataFrame, exact: DataFrame, keys: list[str], count: str, derived: list[str], same: list[str] | None = None
) -> DataFrame:
    """A summary by sketches whose estimate is replaced by whether it lies within three standard errors.

    The measures named by `same` must agree in both summaries as well. With all of them named, both read the same
    columns of the same lines, so that Spark shuffles these once and not once a summary. The observation keeps the
    join's null tests on keys above the exact summary, as they would make its lines others than those of the sketches.
    """
    counted = exact.observe(f"exact {count}", F.count(F.lit(1)).alias("groups"))
    true = counted.select(*keys, *[F.col(c).alias(f"_{c}") for c in [count, *(same or [])]])
    near = is_close(F.col(count), F.col(f"_{count}"))
    for c in same or []:
        near = near & F.col(c).eqNullSafe(F.col(f"_{c}"))
    extra = [c for c in true.columns if c not in keys]
    return close.join(true, keys, "left").withColumn(f"{count}_close", F.coalesce(near, F.lit(False))).drop(count, *extra, *derived)


@query
def category_performance_approx(spark, sf_dir):
    """The summary by sketches, each estimate checked against the exact count and the other measures against the exact summary's."""
    inputs = (src.transactions(spark, sf_dir), src.articles(spark, sf_dir), src.AUDIT_TS)
    keys = ["sale_date", "department", "category", "subcategory", "region", "sales_channel"]
    count, derived = "unique_customers", ["revenue_per_customer"]
    exact = gold.category_performance(*inputs, approximate=False)
    close = gold.category_performance(*inputs)
    same = [c for c in close.columns if c not in (*keys, count, *derived, *AUDIT_COLUMNS)]
    return _checked(close, exact, keys, count, derived, same)


def _daily() -> dict:
    """What a day's summary of events is made of."""
    return {
        "day": F.col("ts"),
        "dimensions": ["channel", "tier"],
        "entity": "user_id",
        "amount": "value",
        "quantity": "quantity",
        "active": F.col("event_type") != "error",
        "rates": {"purchase": F.col("event_type") == "purchase"},
    }


@query
def daily_summary(spark, sf_dir):
    rows = src.measured_events(src.table(spark, sf_dir, "events"))
    return gold.daily_summary(rows, **_daily(), noun="user", audit_ts=src.AUDIT_TS, approximate=False)


@query
def daily_summary_approx(spark, sf_dir):
    """The summary by sketches, each estimate checked against the exact count."""
    rows = src.measured_events(src.table(spark, sf_dir, "events"))
    close, exact = (gold.daily_summary(rows, **_daily(), noun="user", audit_ts=src.AUDIT_TS, approximate=a) for a in (True, False))
    keys = ["date", "channel", "tier"]
    return _checked(close, exact, keys, "unique_users", ["amount_per_user", "records_per_user"])


@query
def users_rolled_up(spark, sf_dir):
    """Sketches kept by day, rolled up to weeks without the rows, and checked against the exact count."""
    rows = src.measured_events(src.table(spark, sf_dir, "events"))
    folder = work_folder(spark, "sketches")
    gold.entity_sketches(rows, F.col("ts"), ["channel", "tier"], "user_id").write.parquet(folder)
    week = F.date_trunc("WEEK", "date").cast("date").alias("week")
    close = gold.rolled_up(spark.read.parquet(folder), [week, "channel"], "user")
    exact = rows.groupBy(F.date_trunc("WEEK", "ts").cast("date").alias("week"), "channel").agg(
        F.count_distinct("user_id").alias("unique_users")
    )
    return _checked(close, exact, ["week", "channel"], "unique_users", [])


@query
def daily_summary_stream(spark, sf_dir):
    """The summary kept over three starts of a stream: parts by user in Spark's state, folded when read."""
    folder = work_folder(spark, "daily")
    events = src.table(spark, sf_dir, "events")

    def start() -> StreamingQuery:
        rows = src.measured_events(read_stream(spark, "parquet", events.schema, f"{folder}/in"))
        return state.aggregate_stream(gold.daily_parts(rows, **_daily()), f"{folder}/out", f"{folder}/checkpoint")

    _in_pieces(events, f"{folder}/in", "event_id", start)
    schema = gold.daily_parts(src.measured_events(events), **_daily()).schema
    parts = state.aggregate_state(spark, f"{folder}/out", schema, ["date", "channel", "tier", "user_id"])
    return gold.daily_fold(parts, ["channel", "tier"], "user_id", "user", src.AUDIT_TS)


@query
def flow_health(spark, sf_dir):
    return gold.flow_performance(src.event_log(spark, sf_dir), date(2024, 2, 10), src.AUDIT_TS)


@query
def exploded_metrics(spark, sf_dir):
    """Words of whole documents by source, with the languages each word occurs in."""
    documents = src.table(spark, sf_dir, "documents").withColumn("words", F.split("text", " "))
    out = gold.exploded_metrics(
        documents, "doc_id", "source", "n_chars", "words", "word", "document", "lang", key_is_unique=True
    )
    return out.withColumn("lang_set", F.array_join("lang_set", ","))


@query
def article_lookup(spark, sf_dir):
    facts = src.transactions(spark, sf_dir, with_order=False, with_store=False)
    return gold.article_lookup(facts, src.articles(spark, sf_dir), ["transaction_id", "total_amount"])


@query
def left_join_report(spark, sf_dir):
    return gold.totals_per_entity(
        src.table(spark, sf_dir, "customer"),
        "c_custkey",
        src.table(spark, sf_dir, "orders"),
        "o_custkey",
        "o_totalprice",
    )


# Ledger


@query
def ledger_detect_changes(spark, sf_dir):
    """Requests whose text differs from the text in the inventory; the first request of a target counts."""
    tables, columns = src.inv_tables(spark, sf_dir), src.inv_columns(spark, sf_dir)
    prepared = ledger.prepare_submissions(src.requests(spark, sf_dir), tables, src.SUBMITTED_AT)
    edited = prepared.groupBy(*ledger.TARGET).agg(F.min_by("suggestion", "request_id").alias("new_value"))
    shown = ledger.current_values(edited.select(*ledger.TARGET), tables, columns)
    return ledger.detect_changes(shown.withColumnRenamed("current_value", "old_value"), edited)


def _submission(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prepared = ledger.prepare_submissions(
        src.requests(spark, sf_dir), src.inv_tables(spark, sf_dir), src.SUBMITTED_AT
    )
    return ledger.submit(src.ledger(spark, sf_dir), prepared)


@query
def ledger_submit(spark, sf_dir):
    return _submission(spark, sf_dir)[0].drop("change_id")


@query
def ledger_submit_rejected(spark, sf_dir):
    return _submission(spark, sf_dir)[1]


@query
def ledger_review(spark, sf_dir):
    rows = src.ledger(spark, sf_dir)
    return ledger.review(rows, src.decisions(rows))


@query
def ledger_review_pending(spark, sf_dir):
    rows = src.ledger(spark, sf_dir)
    return ledger.review(rows, src.decisions(rows), only_pending=True)


@query
def ledger_best(spark, sf_dir):
    return ledger.best_suggestions(src.ledger(spark, sf_dir))


@query
def ledger_overlay(spark, sf_dir):
    return ledger.overlay(src.inv_tables(spark, sf_dir), src.inv_columns(spark, sf_dir), src.ledger(spark, sf_dir))


@query
def ledger_sync_plan(spark, sf_dir):
    return ledger.sync_plan(src.ledger(spark, sf_dir), src.inv_tables(spark, sf_dir))


def _applied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ledger.apply_approved(
        src.inv_tables(spark, sf_dir), src.inv_columns(spark, sf_dir), src.ledger(spark, sf_dir)
    )


@query
def ledger_apply_tables(spark, sf_dir):
    return _applied(spark, sf_dir)[0].drop("properties", "rule_count")


@query
def ledger_apply_columns(spark, sf_dir):
    return _applied(spark, sf_dir)[1]


@query
def ledger_mark_synced(spark, sf_dir):
    """Mark the planned changes whose statement went to a real table."""
    rows = src.ledger(spark, sf_dir)
    plan = ledger.sync_plan(rows, src.inv_tables(spark, sf_dir))
    done = plan.filter(~F.contains("statement", F.lit("VIEW")))
    return ledger.mark_synced(rows, done)


@query
def ledger_retention(spark, sf_dir):
    return ledger.retained(src.ledger(spark, sf_dir), datetime(2024, 2, 15, tzinfo=timezone.utc))


@query
def pending_rows(spark, sf_dir):
    return ledger.pending_rows(src.ledger(spark, sf_dir))


@query
def not_synced(spark, sf_dir):
    return ledger.not_synced(src.ledger(spark, sf_dir))


@query
def pending_queue(spark, sf_dir):
    return ledger.pending_queue(src.ledger(spark, sf_dir))


@query
def pending_by_asset(spark, sf_dir):
    tables = src.inv_tables(spark, sf_dir)
    assets = tables.select(*[F.col(t).alias(a) for t, a in zip(governance.TABLE_KEY, ledger.ASSET)])
    return ledger.pending_changes(src.ledger(spark, sf_dir), assets)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a person with a mail address."""
    name = F.concat(F.lit("user_"), F.col("c_custkey").cast("string"), F.lit("@corp.example"))
    return src.table(spark, sf_dir, "customer").select(name.alias("user_id"))


@query
def user_history(spark, sf_dir):
    return ledger.submitter_history(src.ledger(spark, sf_dir), _people(spark, sf_dir), submitter=True)


@query
def user_kpis(spark, sf_dir):
    return ledger.submitter_kpis(src.ledger(spark, sf_dir))


@query
def reviewer_history(spark, sf_dir):
    return ledger.reviewer_history(src.ledger(spark, sf_dir), status="approved")


@query
def reviewer_kpis(spark, sf_dir):
    return ledger.reviewer_kpis(src.ledger(spark, sf_dir))


@query
def ledger_history(spark, sf_dir):
    return ledger.review_history(src.ledger(spark, sf_dir))


# Catalog figures


@query
def schema_listing(spark, sf_dir):
    rows = src.inv_tables(spark, sf_dir).filter(is_user_schema(F.col("table_schema")))
    return rows.select("table_catalog", F.col("table_schema").alias("schema_name")).distinct()


@query
def metadata_kpis(spark, sf_dir):
    allowed = {"cat_0": [], "cat_1": ["sch_0", "sch_1", "sch_2"]}
    return governance.kpi_cache(
        src.inv_tables(spark, sf_dir),
        src.inv_columns(spark, sf_dir),
        src.ledger(spark, sf_dir),
        src.AUDIT_TS,
        allowed,
    )


@query
def column_coverage(spark, sf_dir):
    return governance.column_coverage(src.inv_columns(spark, sf_dir))


@query
def leaderboards(spark, sf_dir):
    return governance.leaderboards(src.ledger(spark, sf_dir))


@query
def conformance_(spark, sf_dir):
    return conformance.conformance(
        src.inv_tables(spark, sf_dir), src.inv_columns(spark, sf_dir), src.observed_sources(spark, sf_dir)
    )



def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """A short sorted listing with the place of each row, since the order of rows is not compared."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query
def catalog_schemas(spark, sf_dir):
    return _placed(list_schemas(src.inv_tables(spark, sf_dir), "cat_0"), "schema_name")


@query
def schema_tables(spark, sf_dir):
    """Tables of one schema with their dotted names for display."""
    listed = list_tables(src.inv_tables(spark, sf_dir), "cat_1", "sch_1")
    named = listed.withColumn("full_name", qualified_name(F.lit("cat_1"), F.lit("sch_1"), F.col("table_name")))
    return _placed(named, "table_name")


@query
def coverage_counts(spark, sf_dir):
    """The coverage counts in one row, tables without any described column among them."""
    return governance.coverage(src.inv_tables(spark, sf_dir), src.inv_columns(spark, sf_dir))


def _kpi_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache as a reader finds it: a declared table, refreshed twice."""
    folder = work_folder(spark, "kpi-cache")
    rows = governance.kpi_cache(
        src.inv_tables(spark, sf_dir), src.inv_columns(spark, sf_dir), src.ledger(spark, sf_dir), src.AUDIT_TS
    )
    with _declared(spark, folder) as (name, location):
        create_table(spark, METADATA_KPIS, name, location)
        for _ in range(2):
            governance.refresh_cache(rows, name)
        return spark.read.schema(METADATA_KPIS.schema).parquet(location)


@query
def kpi_listing(spark, sf_dir):
    """The cached KPIs in listing order, with the time of the last refresh."""
    cache = _kpi_cache(spark, sf_dir)
    listed = governance.cache_listing(cache).select("metric_name", "user_id", "user_count", "user_rank")
    last = governance.last_refresh(cache).first().last_refresh
    return _placed(listed, "metric_name", "user_rank").withColumn("last_refresh", F.lit(last))


@query
def kpi_metrics(spark, sf_dir):
    return governance.cached_metrics(_kpi_cache(spark, sf_dir))


@query
def kpi_board(spark, sf_dir):
    return governance.cached_board(_kpi_cache(spark, sf_dir), governance.REVIEWERS)

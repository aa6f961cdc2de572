"""Declared tables, overwrite and keyed rewrite sinks, schema alignment, row counts."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.functions.measures import date_key
from stratiform.session import setting
from stratiform.operators.quality import Rule
from stratiform.sources.files import discard, publish, read_csv, read_csv_marked, reject_counts, typed_fields
from stratiform.specs import TableSpec


def create_table(spark: SparkSession, spec: TableSpec, table: str, location: str | None = None) -> None:
    spark.sql(spec.ddl(table, location))


def _aligned(df: DataFrame, schema: T.StructType) -> list[Column]:
    have = set(df.columns)
    return [
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in their order: missing ones as typed NULL, unknown ones left out."""
    return df.select(*_aligned(df, schema))


def laid_out(df: DataFrame, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()) -> DataFrame:
    """Rows arranged for a write.

    The rebalance hint brings the rows of a partition value together so that it gets few files, and
    AQE splits a value that holds too many rows over several tasks. Sorting by the cluster columns
    gives Parquet narrow min/max ranges to skip by.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    order = [*partition_by, *cluster_by]
    return df.sortWithinPartitions(*order) if order else df


def write_files(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    only_given_partitions: bool = False,
) -> None:
    """Overwrite a Parquet folder, or only the partitions that arrive."""
    writer = laid_out(df, partition_by, cluster_by).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    mode = "dynamic" if only_given_partitions else "static"
    writer.option("partitionOverwriteMode", mode).parquet(path)


def write_table(
    df: DataFrame,
    spec: TableSpec,
    table: str,
    overwrite: bool = True,
    only_given_partitions: bool = False,
    observation: Observation | None = None,
    metrics: Sequence[Column] = (),
) -> None:
    """Write into a declared table by name; the declaration with its comments stays. Its files are packed by zstd.

    `metrics` are aggregates over the written rows and any further columns of `df`. They are counted in the
    writing tasks themselves, behind the last shuffle, where a lost executor counts nothing twice.
    """
    spark = df.sparkSession
    rows = align_to_schema(df, spec.schema)
    if observation is not None:
        more = [c for c in df.columns if c not in spec.columns]
        rows = df.select(*_aligned(df, spec.schema), *more)
    rows = laid_out(rows, spec.partition_by, spec.cluster_by)
    if observation is not None:
        rows = rows.observe(observation, *metrics)
    stored = spark.table(table).columns
    mode = "dynamic" if only_given_partitions else "static"
    with (
        setting(spark, "spark.sql.sources.partitionOverwriteMode", mode),
        setting(spark, "spark.sql.parquet.compression.codec", "zstd"),
    ):
        rows.select(*stored).write.insertInto(table, overwrite=overwrite)


class RuleViolation(ValueError):
    """Fail rules that rows broke, with the number of rows for each."""

    def __init__(self, violations: Mapping[str, int]):
        self.violations = dict(violations)
        super().__init__("; ".join(f"rule {name} violated by {n} rows" for name, n in self.violations.items()))


def write_checked(df: DataFrame, rules: Sequence[Rule], path: str) -> dict[str, int]:
    """Overwrite a Parquet folder with the rows that pass the rules, unless a fail rule is broken.

    One pass writes a folder beside the target and counts the violations of every rule in the writing
    tasks. A broken fail rule raises with its name and count, and the target stays as it was; otherwise the
    folder takes the target's place. Returns the violations of each rule, and all rows as `rows`.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    seen = Observation()
    counts = [F.count_if(~r.passes()).alias(r.name) for r in rules]
    dropped = [r.passes() for r in rules if r.action == "drop"]
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    for passes in dropped:
        rows = rows.filter(passes)
    rows.write.parquet(staged)
    found = seen.get
    broken = {r.name: found[r.name] for r in rules if r.action == "fail" and found[r.name]}
    if broken:
        discard(spark, staged)
        raise RuleViolation(broken)
    publish(spark, staged, path)
    return found


def load_csv(
    spark: SparkSession,
    spec: TableSpec,
    path: str,
    table: str,
    location: str | None = None,
    only_given_partitions: bool = False,
) -> DataFrame:
    """Load a CSV into its declared table; one pass reads, writes and counts.

    Returns a row `table_name, row_count, rejects`: rows loaded, and for each column that is no text how
    many values its type refused (they are NULL in the table). A declared `date_key` that the file lacks is
    derived from `transaction_date`. `only_given_partitions` leaves the table's other partitions as they are.
    """
    create_table(spark, spec, table, location)
    names = [*(f.name for f in typed_fields(spec) if f.name != "date_key" or not _derives_key(spec)), "_line"]
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("_rows"), *reject_counts(names)]
    write_table(typed_rows(spark, spec, path, marked=True), spec, table, True, only_given_partitions, seen, metrics)
    counts = seen.get
    report = [(table, counts["_rows"], {n: counts[n] for n in names})]
    return spark.createDataFrame(report, "table_name string, row_count bigint, rejects map<string, bigint>")


def _derives_key(spec: TableSpec) -> bool:
    return "date_key" in spec.columns and "transaction_date" in spec.columns


def typed_rows(spark: SparkSession, spec: TableSpec, path: str, marked: bool = False) -> DataFrame:
    """CSV rows by spec, with `date_key` added where the spec wants it from the date of sale."""
    read = read_csv_marked if marked else read_csv
    if _derives_key(spec):
        fields = [f for f in spec.schema.fields if f.name != "date_key"]
        bare = TableSpec(spec.name, spec.comment, T.StructType(fields), date_format=spec.date_format)
        return read(spark, bare, path).withColumn("date_key", date_key(F.col("transaction_date")))
    return read(spark, spec, path)


def row_counts(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """Rows `table_name, row_count`."""
    counts = [
        spark.table(t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        for t in tables
    ]
    return reduce(DataFrame.unionByName, counts)


def update_by_key(
    table: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], where: Column | None = None
) -> DataFrame:
    """The table with `columns` replaced on the rows whose key has an update.

    `updates` has one row per key and may set a column to NULL. `where` limits the rows that may change.
    """
    marked = updates.select(key, F.struct(*columns).alias("_set"))
    joined = table.join(marked, key, "left")
    hit = F.col("_set").isNotNull()
    if where is not None:
        hit = hit & F.coalesce(where, F.lit(False))
    return joined.select(
        *[
            F.when(hit, F.col(f"_set.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`")
            for c in table.columns
        ]
    )


def update_partitions(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    partition_by: Sequence[str],
    updates: DataFrame,
    key: str,
    columns: Sequence[str],
    where: Column | None = None,
) -> None:
    """Keyed update of a partitioned Parquet folder: partitions that hold no updated key are left alone.

    A pass over key and partition columns finds the touched partitions; their rows alone are read in full
    and written again by dynamic overwrite, which publishes at the end of the job, so a repeat of a broken
    run starts from the old rows. `updates` is as in `update_by_key` and is meant to be the small side;
    partition columns can't change.
    """
    if set(columns) & set(partition_by):
        raise ValueError("an update can't move a row to another partition")
    table = spark.read.schema(schema).parquet(path)
    touched = table.join(updates.select(key), key, "left_semi").select(*partition_by).distinct()
    same = [table[c].eqNullSafe(touched[c]) for c in partition_by]
    rows = update_by_key(table.join(touched, same, "left_semi"), updates, key, columns, where)
    write_files(rows, path, partition_by, only_given_partitions=True)


def delete_where(table: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not TRUE; an unknown result keeps the row."""
    return table.filter(~F.coalesce(predicate, F.lit(False)))


def rows_with_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_semi")


def migrate(table: DataFrame, add: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Add typed NULL columns that are missing and drop columns that are present."""
    for name, kind in (add or {}).items():
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast(kind))
    return table.drop(*drop)

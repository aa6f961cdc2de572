"""Catalog KPIs: description coverage, leaderboards and their long-format cache."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions.measures import share_pct
from stratiform.functions.text import has_text, user_name
from stratiform.operators.ledger import REJECTED
from stratiform.sources.inventory import INTERNAL_SCHEMAS, TABLE_KEY, in_allow_list
from stratiform.sources.tables import align_to_schema, write_table
from stratiform.specs import METADATA_KPIS

# Metric names of the cache.
COVERAGE = ("total_tables", "tables_with_desc", "tables_all_cols_desc", "tables_partial_cols_desc")
SUGGESTORS, REVIEWERS, REJECTED_SUGGESTORS = "top_suggestor", "top_reviewer", "top_rejected_suggestor"


def _counted(inventory: DataFrame, allowed: Mapping[str, Sequence[str]] | None) -> DataFrame:
    rows = inventory.filter(~F.col("table_schema").isin(*INTERNAL_SCHEMAS))
    return rows if allowed is None else in_allow_list(rows, allowed)


def column_coverage(inv_columns: DataFrame) -> DataFrame:
    """Columns and described columns of each table."""
    return inv_columns.groupBy(*TABLE_KEY).agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(has_text(F.col("comment"))).alias("described_columns"),
    )


def coverage(
    inv_tables: DataFrame, inv_columns: DataFrame, allowed: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One row: the four coverage counts, and the tables without any described column.

    Each inventory is reduced to one row on its own; the two rows are then added up.
    """
    per_table = (
        _counted(inv_tables, allowed)
        .groupBy(*TABLE_KEY)
        .agg(F.bool_or(has_text(F.col("comment"))).alias("described"))
    )
    tables = per_table.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if("described").alias("tables_with_desc"),
    )
    total, described = F.col("total_columns"), F.col("described_columns")
    columns = column_coverage(_counted(inv_columns, allowed)).agg(
        F.count_if((total == described) & (total > 0)).alias("tables_all_cols_desc"),
        F.count_if((described > 0) & (described < total)).alias("tables_partial_cols_desc"),
    )
    both = tables.unionByName(columns, allowMissingColumns=True)
    summed = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COVERAGE])
    rest = F.col("total_tables") - F.col("tables_all_cols_desc") - F.col("tables_partial_cols_desc")
    return summed.withColumn("tables_no_cols_desc", rest)


def coverage_rows(counts: DataFrame) -> DataFrame:
    """The coverage row as `metric_name, metric_value, metric_percentage`; the total has no percentage."""
    lines = [
        F.struct(
            F.lit(name).alias("metric_name"),
            F.col(name).alias("metric_value"),
            (
                F.lit(None).cast("double") if name == "total_tables" else share_pct(F.col(name), F.col("total_tables"))
            ).alias("metric_percentage"),
        )
        for name in COVERAGE
    ]
    return counts.select(F.inline(F.array(*lines)))


def leaderboards(ledger: DataFrame, size: int = 3) -> DataFrame:
    """Top users of the three boards: `metric_name, user_id, user_count, user_rank`.

    One scan feeds all boards. Users are counted before the shuffle, and the rank is limited in each
    task before the rows of a board meet.
    """
    submitter, reviewer = user_name(F.col("suggestor_id")), user_name(F.col("reviewer_id"))
    entries = F.array(
        F.struct(F.lit(SUGGESTORS).alias("metric_name"), submitter.alias("user_id")),
        F.when(
            F.col("reviewer_id").isNotNull(),
            F.struct(F.lit(REVIEWERS).alias("metric_name"), reviewer.alias("user_id")),
        ),
        F.when(
            F.col("status") == REJECTED,
            F.struct(F.lit(REJECTED_SUGGESTORS).alias("metric_name"), submitter.alias("user_id")),
        ),
    )
    counts = (
        ledger.select(F.explode(F.array_compact(entries)).alias("entry"))
        .groupBy("entry.metric_name", "entry.user_id")
        .agg(F.count(F.lit(1)).alias("user_count"))
    )
    order = Window.partitionBy("metric_name").orderBy(F.col("user_count").desc(), "user_id")
    return counts.withColumn("user_rank", F.row_number().over(order)).filter(F.col("user_rank") <= size)


def kpi_cache(
    inv_tables: DataFrame,
    inv_columns: DataFrame,
    ledger: DataFrame,
    refreshed_at: datetime,
    allowed: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """All KPIs in the long cache format: 4 coverage rows and up to 9 board rows, in one plan."""
    rows = coverage_rows(coverage(inv_tables, inv_columns, allowed)).unionByName(
        leaderboards(ledger), allowMissingColumns=True
    )
    stamped = rows.withColumn("refresh_timestamp", F.lit(refreshed_at).cast("timestamp"))
    return align_to_schema(stamped, METADATA_KPIS.schema)


def refresh_cache(cache: DataFrame, table: str) -> None:
    """Replace the cache in one overwrite, so readers never see it empty."""
    write_table(cache, METADATA_KPIS, table)


def cached_metrics(cache: DataFrame) -> DataFrame:
    return cache.filter(F.col("metric_name").isin(*COVERAGE)).select(
        "metric_name", F.coalesce("metric_value", F.lit(0)).alias("metric_value")
    )


def cached_board(cache: DataFrame, board: str) -> DataFrame:
    return (
        cache.filter(F.col("metric_name") == board).select("user_id", "user_count", "user_rank").orderBy("user_rank")
    )


def cache_listing(cache: DataFrame) -> DataFrame:
    return cache.orderBy("metric_name", "user_rank")


def last_refresh(cache: DataFrame) -> DataFrame:
    return cache.agg(F.max("refresh_timestamp").alias("last_refresh"))

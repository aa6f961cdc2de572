"""Raw layer: audit columns, key filter, provenance, column order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.specs import AUDIT_COLUMNS

# Allowed values of the audit column `source_system`, by layer.
SOURCE_SYSTEMS = {
    "bronze": ("pos", "ecommerce", "product_catalog", "date_dimensions", "inventory"),
    "silver": ("silver_transformation",),
    "gold": ("gold_aggregation",),
}
SILVER_SOURCE = "silver_transformation"
GOLD_SOURCE = "gold_aggregation"


def with_audit(df: DataFrame, audit_ts: datetime, source_system: str) -> DataFrame:
    """Append the audit pair as the last columns.

    The time is a parameter, one literal per run, so a retried or repeated run writes the same rows.
    """
    kept = [c for c in df.columns if c not in AUDIT_COLUMNS]
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.lit(audit_ts).cast("timestamp").alias("audit_ts"),
        F.lit(source_system).alias("source_system"),
    )


def with_source_file(df: DataFrame) -> DataFrame:
    """Path of the file each row came from; `df` must be a direct file read."""
    return df.select("*", F.col("_metadata.file_path").alias("_source_file"))


def keyed_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with every key present; plain NULL tests reach the file scan."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def bronze(
    df: DataFrame, keys: Sequence[str], audit_ts: datetime, source_system: str, source_file: bool = False
) -> DataFrame:
    """Raw table: all columns as they are, rows without a key left out, provenance, audit pair."""
    if source_file:
        df = with_source_file(df)
    return with_audit(keyed_rows(df, keys), audit_ts, source_system)


def order_columns(
    df: DataFrame,
    keys: Sequence[str] = (),
    dimensions: Sequence[str] = (),
    measures: Sequence[str] = (),
    derived: Sequence[str] = (),
    flags: Sequence[str] = (),
) -> DataFrame:
    """Standard order: keys, dimensions, measures, derived, flags, audit pair.

    Columns named in no list stay between the dimensions and the measures.
    """
    last = [c for c in AUDIT_COLUMNS if c in df.columns]
    placed = {*keys, *dimensions, *measures, *derived, *flags, *last}
    rest = [c for c in df.columns if c not in placed]
    return df.select(*keys, *dimensions, *rest, *measures, *derived, *flags, *last)

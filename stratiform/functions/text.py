"""Text, user and description expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ledger.
TABLE_FORMAT = "table description"
COLUMN_FORMAT = "column description"
ADD_NEW, MODIFY, DELETE = "add new", "modify", "delete"


def trimmed(name: str) -> Column:
    return F.trim(F.col(name)).alias(name)


def title_cased(name: str) -> Column:
    return F.initcap(F.trim(F.col(name))).alias(name)


def upper_cased(name: str) -> Column:
    return F.upper(F.trim(F.col(name))).alias(name)


def stripped(value: Column) -> Column:
    """Text without white space at both ends, tabs and newlines included; NULL becomes empty."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")


def has_text(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != F.lit("")


def same_text(left: Column, right: Column) -> Column:
    return stripped(left) == stripped(right)


def user_name(user: Column) -> Column:
    """The part before `@`, so one person counts once with or without a mail domain."""
    return F.substring_index(user, "@", 1)


def qualified_name(*parts: Column) -> Column:
    """Dotted name, for display only: joins and counts use the parts."""
    return F.concat_ws(".", *parts)


def change_kind(old: Column, new: Column) -> Column:
    return (
        F.when(stripped(old) == "", ADD_NEW).when(stripped(new) == "", DELETE).otherwise(MODIFY)
    )


def asset_kind(table_type: Column) -> Column:
    """Ledger name of an inventory table type; both spellings of materialized view are known."""
    kind = F.upper(F.replace(table_type, F.lit("_"), F.lit(" ")))
    return (
        F.when(kind == "VIEW", "view")
        .when(kind == "MATERIALIZED VIEW", "materialized view")
        .otherwise("table")
    )


def sql_text(value: Column) -> Column:
    """Text as a quoted SQL literal: backslashes and quotes doubled."""
    plain = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_name(*parts: Column) -> Column:
    """A dotted name for a statement, each part in backticks."""
    tick = F.lit("`")
    return F.concat_ws(".", *[F.concat(tick, F.replace(p, tick, F.lit("``")), tick) for p in parts])


def is_synced(flag: Column, suggestion: Column, current: Column) -> Column:
    """Synced when flagged, or when the suggested text already is the current text."""
    return F.coalesce(flag, F.lit(False)) | same_text(suggestion, current)

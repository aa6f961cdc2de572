"""Typing, money and ratio expressions.

Money arrives as DOUBLE. A sum of DOUBLE depends on the order of rows, and a DECIMAL sum costs an
object per row. `exact_sum` adds whole units and millionths (or other decimals) as two BIGINT sums, which
is exact for values of up to so many decimals, needs no objects and leaves room for 9e18 units per group.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(value: Column, places: int = 6) -> Column:
    """Order-independent sum as DECIMAL; values are rounded to `places` decimals, 0 to 9.

    More places leave less room for rows: a group may hold 9e18 / 10**places of them.
    """
    if not 0 <= places <= 9:
        raise ValueError("places are 0 to 9")
    units = F.floor(value)
    parts = F.rint((value - units) * F.lit(10.0**places)).cast("bigint")
    return F.sum(units).cast("decimal(20,0)") + F.sum(parts).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-places))


def money(total: Column) -> Column:
    """An exact total rounded to cents."""
    return F.round(total, 2).cast("double")


def ratio(numerator: Column, denominator: Column, factor: float | None = None) -> Column:
    """numerator / denominator * factor without rounding; NULL when the denominator is zero."""
    value = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return value if factor is None else value * F.lit(float(factor))


def rounded_ratio(numerator: Column, denominator: Column, factor: float | None = None) -> Column:
    return F.round(ratio(numerator, denominator, factor), 2)


def count_pct(hits: Column, rows: Column) -> Column:
    """Counted hits as a percentage of counted rows."""
    return F.round(hits.cast("double") * F.lit(100.0) / rows.cast("double"), 2)


def share_pct(part: Column, total: Column) -> Column:
    """part / total * 100, and 0 for an empty total."""
    return F.when(total > 0, part.cast("double") / total.cast("double") * F.lit(100.0)).otherwise(
        F.lit(0.0)
    )


def margin(price: Column, cost: Column) -> Column:
    return F.round(price - cost, 2)


def margin_pct(price: Column, cost: Column) -> Column:
    return F.round((price - cost) / F.nullif(price, F.lit(0.0)) * F.lit(100.0), 2)


def performance_band(profit: Column, revenue: Column) -> Column:
    """Band of a profit; zero revenue has no percentage and so stays NORMAL unless it is a loss."""
    pct = ratio(profit, revenue, 100)
    return (
        F.when(profit < 0, "LOSS")
        .when(pct < 10, "LOW_MARGIN")
        .when(pct >= 30, "HIGH_MARGIN")
        .otherwise("NORMAL")
    )


def health_band(errors: Column) -> Column:
    return F.when(errors == 0, "GREEN").when(errors <= 2, "YELLOW").otherwise("RED")


def json_minutes(details: Column, path: str = "$.duration_ms") -> Column:
    """A duration in milliseconds inside JSON text, as minutes."""
    return F.get_json_object(details, path).try_cast("double") / F.lit(60000.0)


def tried(name: str, kind: str) -> Column:
    """A cast that gives NULL for bad text in place of an error."""
    return F.col(name).try_cast(kind).alias(name)


def cast_failed(name: str, kind: str) -> Column:
    """True where a value is present and cannot be cast."""
    return F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()


def is_true(condition: Column) -> Column:
    """A flag that is TRUE or FALSE, never NULL."""
    return F.coalesce(condition, F.lit(False))


def date_key(day: Column) -> Column:
    """A date as the number YYYYMMDD."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("bigint")


def recent(day: Column, as_of: Column, days: int) -> Column:
    """Not older than `days` days before `as_of`."""
    return day >= F.date_sub(as_of, days)

"""Retail calendar, one row per day, with fiscal periods, seasons, promotions and holidays.

The rules are column expressions over the day, so the calendar is one projection with no join. A
calendar is small by nature: at most 366 rows a year.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGULAR = "Regular Trading"

# Promotions by first and last (month, day); the first that fits wins.
# Black Friday Week has no fixed day: it is the week, Monday to Sunday, of the day after the fourth
# Thursday of November.
PROMOTIONS = (
    ("Summer Sale", (7, 1), (7, 31)),
    ("Back to School", (8, 15), (9, 15)),
    ("Christmas Trading", (12, 1), (12, 24)),
    ("Boxing Day Sales", (12, 26), (12, 31)),
    ("Boxing Day Sales", (1, 1), (1, 2)),
    ("January Sale", (1, 3), (1, 31)),
)
BLACK_FRIDAY = "Black Friday Week"

# First month of each season.
SEASONS = (("Spring", 3), ("Summer", 6), ("Autumn", 9), ("Winter", 12))


def days_between(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row `full_date` per day, both ends included."""
    bounds = spark.range(1).select(F.lit(start).alias("first"), F.lit(end).alias("last"))
    return _each_day(bounds)


def days_of(df: DataFrame, day: Column) -> DataFrame:
    """One row `full_date` per day from the first to the last day found in `df`."""
    day = day.cast("date")
    return _each_day(df.agg(F.min(day).alias("first"), F.max(day).alias("last")))


def _each_day(bounds: DataFrame) -> DataFrame:
    steps = F.sequence("first", "last", F.expr("interval 1 day"))
    return bounds.filter(F.col("first") <= F.col("last")).select(F.explode(steps).alias("full_date"))


def default_holidays(day: Column) -> Column:
    """Name of the public holiday on a day, else NULL."""
    month, dom = F.month(day), F.dayofmonth(day)
    last_monday = (month == 8) & (F.weekday(day) == 0) & (dom >= 25)
    return (
        F.when((month == 1) & (dom == 1), "New Year's Day")
        .when(last_monday, "August Bank Holiday")
        .when((month == 12) & (dom == 25), "Christmas Day")
        .when((month == 12) & (dom == 26), "Boxing Day")
    )


def default_promotion(day: Column) -> Column:
    month, dom = F.month(day), F.dayofmonth(day)
    name = F.lit(REGULAR)
    for label, first, last in reversed(PROMOTIONS):
        position = month * 100 + dom
        name = F.when(
            position.between(first[0] * 100 + first[1], last[0] * 100 + last[1]), F.lit(label)
        ).otherwise(name)
    fourth_thursday = F.date_add(F.next_day(F.make_date(F.year(day), F.lit(10), F.lit(31)), "Thu"), 21)
    monday = F.date_sub(fourth_thursday, 3)
    return F.when(F.datediff(day, monday).between(0, 6), F.lit(BLACK_FRIDAY)).otherwise(name)


def dated_promotion(day: Column, ranges: Sequence[tuple[str, date, date]]) -> Column:
    name = F.lit(REGULAR)
    for label, first, last in reversed(list(ranges)):
        name = F.when(day.between(F.lit(first), F.lit(last)), F.lit(label)).otherwise(name)
    return name


def date_dimension(
    days: DataFrame,
    holidays: Mapping[date, str] | None = None,
    promotions: Sequence[tuple[str, date, date]] | None = None,
    fiscal_start_month: int = 2,
    holidays_off: bool = False,
    iso_year_week: bool = False,
) -> DataFrame:
    """All calendar columns for a DataFrame of `full_date`.

    A fiscal year starts on the first of `fiscal_start_month` and carries the number of the year it
    ends in. Holidays count as working days unless `holidays_off`. `year_week` joins the calendar year
    to the ISO week, `iso_year_week` (optional) is the ISO year and week.
    """
    day = F.col("full_date")
    year, quarter, month = F.year(day), F.quarter(day), F.month(day)
    week, weekday = F.weekofyear(day), F.weekday(day) + 1
    fiscal_month = F.pmod(month - fiscal_start_month, F.lit(12)) + 1
    fiscal_year = year + F.when(month >= fiscal_start_month, 1).otherwise(0) if fiscal_start_month > 1 else year
    fiscal_quarter = F.floor((fiscal_month - 1) / 3) + 1
    if holidays is None:
        holiday = default_holidays(day)
    else:
        holiday = F.lit(None).cast("string")
        for when, label in holidays.items():
            holiday = F.when(day == F.lit(when), F.lit(label)).otherwise(holiday)
    promotion = default_promotion(day) if promotions is None else dated_promotion(day, promotions)
    season = F.lit("Winter")
    for label, first in SEASONS:
        season = F.when((month >= first) & (month < first + 3), F.lit(label)).otherwise(season)
    weekend = weekday >= 6
    working = ~weekend & holiday.isNull() if holidays_off else ~weekend
    next_day = F.date_add(day, 1)

    def two(value: Column) -> Column:
        return F.lpad(value.cast("string"), 2, "0")

    def flag(condition: Column) -> Column:
        return F.when(condition, "Y").otherwise("N")

    def starts(unit: str) -> Column:
        return flag(day == F.trunc(day, unit))

    def ends(unit: str) -> Column:
        return flag(next_day == F.trunc(next_day, unit))

    fiscal_start = (month == fiscal_start_month) & (F.dayofmonth(day) == 1)
    fiscal_end = (F.month(next_day) == fiscal_start_month) & (F.dayofmonth(next_day) == 1)
    columns = {
        "date_key": year * 10000 + month * 100 + F.dayofmonth(day),
        "full_date": day,
        "calendar_year": year,
        "calendar_quarter": quarter,
        "calendar_quarter_name": F.concat(F.lit("Q"), quarter.cast("string")),
        "month_number": month,
        "month_name": F.date_format(day, "MMMM"),
        "month_short": F.date_format(day, "MMM"),
        "year_month": F.date_format(day, "yyyy-MM"),
        "month_year_label": F.date_format(day, "MMM yyyy"),
        "week_of_year": week,
        "year_week": F.concat(year.cast("string"), F.lit("-W"), two(week)),
        "day_of_month": F.dayofmonth(day),
        "day_of_week_number": weekday,
        "day_of_week_name": F.date_format(day, "EEEE"),
        "day_of_week_short": F.date_format(day, "EEE"),
        "day_of_year": F.dayofyear(day),
        "fiscal_year": fiscal_year,
        "fiscal_year_label": F.concat(F.lit("FY"), fiscal_year.cast("string")),
        "fiscal_quarter": fiscal_quarter,
        "fiscal_quarter_name": F.concat(F.lit("FQ"), fiscal_quarter.cast("string")),
        "fiscal_month": fiscal_month,
        "fiscal_period": F.concat(F.lit("P"), two(fiscal_month)),
        "retail_season": season,
        "promotional_period": promotion,
        "is_weekend": flag(weekend),
        "is_working_day": flag(working),
        "is_holiday": flag(holiday.isNotNull()),
        "holiday_name": holiday,
        "is_month_start": starts("month"),
        "is_month_end": ends("month"),
        "is_quarter_start": starts("quarter"),
        "is_quarter_end": ends("quarter"),
        "is_year_start": starts("year"),
        "is_year_end": ends("year"),
        "is_fiscal_year_start": flag(fiscal_start),
        "is_fiscal_year_end": flag(fiscal_end),
        "month_sort": month,
        "day_of_week_sort": weekday,
    }
    numbers = {
        "date_key", "calendar_year", "calendar_quarter", "month_number", "week_of_year", "day_of_month",
        "day_of_week_number", "day_of_year", "fiscal_year", "fiscal_quarter", "fiscal_month",
        "month_sort", "day_of_week_sort",
    }
    selected = [(c.cast("bigint") if n in numbers else c).alias(n) for n, c in columns.items()]
    if iso_year_week:
        iso_year = F.year(F.date_add(day, F.lit(4) - weekday))
        selected.append(F.concat(iso_year.cast("string"), F.lit("-W"), two(week)).alias("iso_year_week"))
    return days.select(*selected)

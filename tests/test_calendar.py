from datetime import date

import pytest

from stratiform.operators.calendar import date_dimension, days_between, days_of
from stratiform.specs import DATE_DIMENSIONS
from pyspark.sql import functions as F

# Facts of single days: season, promotion, fiscal quarter, fiscal period, holiday.
GOLDEN = {
    date(2025, 7, 16): ("Summer", "Summer Sale", "FQ2", "P06", None),
    date(2025, 7, 31): ("Summer", "Summer Sale", "FQ2", "P06", None),
    date(2025, 8, 1): ("Summer", "Regular Trading", "FQ3", "P07", None),
    date(2025, 8, 15): ("Summer", "Back to School", "FQ3", "P07", None),
    date(2025, 8, 25): ("Summer", "Back to School", "FQ3", "P07", "August Bank Holiday"),
    date(2025, 9, 1): ("Autumn", "Back to School", "FQ3", "P08", None),
    date(2025, 9, 16): ("Autumn", "Regular Trading", "FQ3", "P08", None),
    date(2025, 11, 23): ("Autumn", "Regular Trading", "FQ4", "P10", None),
    date(2025, 11, 24): ("Autumn", "Black Friday Week", "FQ4", "P10", None),
    date(2025, 11, 30): ("Autumn", "Black Friday Week", "FQ4", "P10", None),
    date(2025, 12, 1): ("Winter", "Christmas Trading", "FQ4", "P11", None),
    date(2025, 12, 25): ("Winter", "Regular Trading", "FQ4", "P11", "Christmas Day"),
    date(2025, 12, 26): ("Winter", "Boxing Day Sales", "FQ4", "P11", "Boxing Day"),
    date(2026, 1, 1): ("Winter", "Boxing Day Sales", "FQ4", "P12", "New Year's Day"),
    date(2026, 1, 3): ("Winter", "January Sale", "FQ4", "P12", None),
}


@pytest.fixture(scope="module")
def by_day(spark):
    days = days_between(spark, date(2025, 7, 16), date(2026, 2, 1))
    return {r.full_date: r for r in date_dimension(days, iso_year_week=True).collect()}


def test_sample_span(spark):
    days = date_dimension(days_between(spark, date(2025, 7, 16), date(2026, 1, 12)))
    assert days.count() == 181
    assert days.columns == DATE_DIMENSIONS.columns
    assert [f.dataType for f in days.schema] == [f.dataType for f in DATE_DIMENSIONS.schema]


@pytest.mark.parametrize("day", GOLDEN)
def test_golden_days(by_day, day):
    r = by_day[day]
    have = (r.retail_season, r.promotional_period, r.fiscal_quarter_name, r.fiscal_period, r.holiday_name)
    assert have == GOLDEN[day]


def test_edges_of_periods(by_day):
    first, last = by_day[date(2026, 1, 1)], by_day[date(2025, 12, 31)]
    assert (first.is_year_start, first.is_quarter_start, first.is_month_start) == ("Y", "Y", "Y")
    assert (last.is_year_end, last.is_quarter_end, last.is_month_end) == ("Y", "Y", "Y")
    assert first.fiscal_year == 2026 and first.is_fiscal_year_start == "N"
    assert by_day[date(2026, 1, 31)].is_fiscal_year_end == "Y"
    assert by_day[date(2026, 2, 1)].is_fiscal_year_start == "Y"
    assert by_day[date(2026, 2, 1)].fiscal_year_label == "FY2027"


def test_weeks_at_the_turn_of_the_year(by_day):
    r = by_day[date(2025, 12, 29)]
    assert (r.week_of_year, r.year_week, r.iso_year_week) == (1, "2025-W01", "2026-W01")


def test_working_days(spark, by_day):
    assert by_day[date(2025, 8, 25)].is_working_day == "Y"
    assert by_day[date(2026, 1, 3)].is_working_day == "N"
    days = days_between(spark, date(2025, 8, 25), date(2025, 8, 25))
    assert date_dimension(days, holidays_off=True).first().is_working_day == "N"


def test_given_holidays_and_promotions(spark):
    days = days_between(spark, date(2025, 7, 16), date(2025, 7, 18))
    out = date_dimension(
        days,
        holidays={date(2025, 7, 17): "Founders"},
        promotions=[("Flash", date(2025, 7, 18), date(2025, 7, 18))],
    ).orderBy("full_date")
    assert [(r.holiday_name, r.promotional_period) for r in out.collect()] == [
        (None, "Regular Trading"),
        ("Founders", "Regular Trading"),
        (None, "Flash"),
    ]


def test_calendar_year_as_fiscal_year(spark):
    days = days_between(spark, date(2025, 3, 1), date(2025, 3, 1))
    r = date_dimension(days, fiscal_start_month=1).first()
    assert (r.fiscal_year, r.fiscal_month) == (2025, 3)


def test_days_of_data(spark):
    df = spark.createDataFrame([(date(2025, 1, 3),), (date(2025, 1, 1),), (None,)], "d date")
    assert days_of(df, F.col("d")).count() == 3
    assert days_of(df.limit(0), F.col("d")).count() == 0

"""Business aggregates over the star schema, event logs and arrays.

Groupings combine before the shuffle, and COUNT(DISTINCT) is planned by Spark in two steps (first by group and
value, then by group), so a hot group never sits in one task; only `sales_totals`, whose groups are small beside
its lines, brings a group's lines together to move them once. Joins are plain equi joins:
Spark broadcasts the dimension when its size allows and otherwise sort-merges with skew splitting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions.measures import (
    count_pct,
    exact_sum,
    health_band,
    json_minutes,
    money,
    performance_band,
    recent,
    rounded_ratio,
)
from stratiform.functions.sketches import estimate, merged, sketch
from stratiform.operators.bronze import GOLD_SOURCE, with_audit
from stratiform.operators.quality import CLEAN


def distinct(column: str, approximate: bool) -> Column:
    """Distinct count, exact or by sketch; the sketch is one small state of bounded size per group."""
    return estimate(sketch(column)) if approximate else F.count_distinct(column)


def entity_sketches(df: DataFrame, day: Column, dimensions: Sequence[str], entity: str) -> DataFrame:
    """Sketches of the distinct entities by day and dimensions, to be kept."""
    return df.groupBy(day.cast("date").alias("date"), *dimensions).agg(
        F.count(F.lit(1)).alias("record_count"), sketch(entity).alias("entity_sketch")
    )


def rolled_up(sketches: DataFrame, by: Sequence[str | Column], noun: str) -> DataFrame:
    """Records and estimated distinct entities at a coarser grain, from kept sketches alone."""
    return sketches.groupBy(*by).agg(
        F.sum("record_count").alias("record_count"), estimate(merged("entity_sketch")).alias(f"unique_{noun}s")
    )


def daily_summary(
    df: DataFrame,
    day: Column,
    dimensions: Sequence[str],
    entity: str,
    noun: str,
    amount: str,
    active: Column,
    audit_ts: datetime,
    quantity: str | None = None,
    rates: Mapping[str, Column] | None = None,
    flag: str | None = "data_quality_flag",
    approximate: bool = True,
    watermark: str | None = None,
) -> DataFrame:
    """Volumes, revenue, ratios and percentages by day and dimensions.

    On a stream a `watermark` such as "2 days" closes a day once it has passed, which drops its state and
    allows append mode; `day` must then be a timestamp. A stream takes the sketch form, or keeps
    `daily_parts`, whose fold has exact distinct entities.
    """
    counted = {"quantity": quantity, "rates": rates, "flag": flag, "watermark": watermark}
    if approximate:
        sketch = distinct(entity, True).alias("_entities")
        totals = _daily_sums(df, day, dimensions, [], amount, active, [sketch], **counted)
    else:
        totals = _parts_sum(daily_parts(df, day, dimensions, entity, amount, active, **counted), dimensions, entity)
    return _daily_measures(totals, dimensions, noun, audit_ts)


def daily_parts(
    df: DataFrame,
    day: Column,
    dimensions: Sequence[str],
    entity: str,
    amount: str,
    active: Column,
    quantity: str | None = None,
    rates: Mapping[str, Column] | None = None,
    flag: str | None = "data_quality_flag",
    watermark: str | None = None,
) -> DataFrame:
    """Counts and sums by day, dimensions and entity: a summary in parts that add up, also on a stream."""
    return _daily_sums(df, day, dimensions, [entity], amount, active, [], quantity, rates, flag, watermark)


def daily_fold(
    parts: DataFrame, dimensions: Sequence[str], entity: str, noun: str, audit_ts: datetime
) -> DataFrame:
    """The summary of `daily_parts`; an entity has one part a group, so distinct entities are a count."""
    return _daily_measures(_parts_sum(parts, dimensions, entity), dimensions, noun, audit_ts)


def _daily_sums(
    df: DataFrame,
    day: Column,
    dimensions: Sequence[str],
    by: Sequence[str],
    amount: str,
    active: Column,
    more: Sequence[Column],
    quantity: str | None,
    rates: Mapping[str, Column] | None,
    flag: str | None,
    watermark: str | None,
) -> DataFrame:
    columns = [*more, F.count(F.lit(1)).alias("_rows"), F.count_if(active).alias("_active")]
    if quantity:
        columns.append(F.sum(quantity).alias("_quantity"))
    columns += [exact_sum(F.col(amount)).alias("_total"), F.count(amount).alias("_amounts")]
    columns += [F.count_if(condition).alias(f"_hits_{name}") for name, condition in (rates or {}).items()]
    if flag:
        columns.append(F.count_if(F.col(flag) == CLEAN).alias("_clean"))
    if watermark is None:
        return df.groupBy(day.cast("date").alias("date"), *dimensions, *by).agg(*columns)
    timed = df.withColumn("_time", day).withWatermark("_time", watermark)
    grouped = timed.groupBy(F.window("_time", "1 day"), *dimensions, *by).agg(*columns)
    return grouped.select(F.col("window.start").cast("date").alias("date"), *grouped.columns[1:])


def _parts_sum(parts: DataFrame, dimensions: Sequence[str], entity: str) -> DataFrame:
    added = [F.sum(c).alias(c) for c in parts.columns if c.startswith("_")]
    return parts.groupBy("date", *dimensions).agg(F.count(entity).alias("_entities"), *added)


def _daily_measures(totals: DataFrame, dimensions: Sequence[str], noun: str, audit_ts: datetime) -> DataFrame:
    rows, entities, total = F.col("_rows"), F.col("_entities"), F.col("_total")
    columns = [
        entities.alias(f"unique_{noun}s"),
        rows.alias(f"{noun}_count"),
        F.col("_active").alias(f"active_{noun}_count"),
        *([F.col("_quantity").alias("total_quantity")] if "_quantity" in totals.columns else []),
        money(total).alias("total_amount"),
        rounded_ratio(total, F.col("_amounts")).alias("avg_amount"),
        rounded_ratio(total, entities).alias(f"amount_per_{noun}"),
        rounded_ratio(rows, entities).alias(f"records_per_{noun}"),
    ]
    for name in totals.columns:
        if name.startswith("_hits_"):
            columns.append(count_pct(F.col(name), rows).alias(f"{name.removeprefix('_hits_')}_rate_pct"))
    if "_clean" in totals.columns:
        columns.append(count_pct(F.col("_clean"), rows).alias("clean_data_rate_pct"))
    return with_audit(totals.select("date", *dimensions, *columns), audit_ts, GOLD_SOURCE)


def star_join(
    facts: DataFrame,
    articles: DataFrame | None = None,
    calendar: DataFrame | None = None,
    article_key: str = "article_id",
    calendar_key: str = "date_key",
    how: str = "inner",
) -> DataFrame:
    """Facts with their dimensions. The calendar joins on its key or on the date itself."""
    if articles is not None:
        facts = facts.join(articles, article_key, how)
    if calendar is not None:
        facts = facts.join(calendar, calendar_key, how)
    return facts


def sales_totals(
    sales: DataFrame, dimensions: Sequence[str | Column], totals: Mapping[str, Column], approximate: bool
) -> DataFrame:
    """Transactions, units, customers and exact totals of sales lines by `dimensions`, in one pass over them.

    A line is shuffled once, by its group, with nothing but what is counted or added; both distinct counts mark
    the first line of each value in the group, in sorts that spill, so no line is copied and no key travels again.
    A transaction counts once, whoever its customers are. The approximate form keeps a sketch of the customers.
    The first of the totals is the one whose rows are counted. A group is within one task.
    """
    values = [value.alias(name) for name, value in totals.items()]
    lines = sales.select(*dimensions, "transaction_id", "customer_id", "quantity", *values)
    by = lines.columns[: len(dimensions)]
    lines = lines.repartition(*by).withColumn("_transaction", _first(by, "transaction_id"))
    customers = distinct("customer_id", True)
    if not approximate:
        lines = lines.withColumn("_customer", _first(by, "customer_id"))
        customers = F.count_if("_customer")
    return lines.groupBy(*by).agg(
        F.count_if("_transaction").alias("transaction_count"),
        customers.alias("unique_customers"),
        F.sum("quantity").alias("total_units_sold"),
        F.count(next(iter(totals))).alias("_rows"),
        *[exact_sum(F.col(name)).alias(name) for name in totals],
    )


def _first(by: Sequence[str], column: str) -> Column:
    """Whether a row is the first of its value within a group; a null is no value."""
    again = F.row_number().over(Window.partitionBy(*by, column).orderBy(column))
    return F.col(column).isNotNull() & (again == 1)


def retail_performance(
    transactions: DataFrame,
    articles: DataFrame,
    calendar: DataFrame,
    audit_ts: datetime,
    calendar_dimensions: Sequence[str] = ("year_month", "retail_season"),
    article_dimensions: Sequence[str] = ("department", "category"),
    approximate: bool = True,
) -> DataFrame:
    """Sales and profit by day, calendar, article and region, with a performance band.

    A day has one calendar row, so the calendar joins the totals of a day and not its sales lines.
    """
    joined = star_join(transactions, articles.select("article_id", "base_cost", *article_dimensions))
    day = F.col("transaction_date").alias("date")
    totals = sales_totals(
        joined,
        [day, "date_key", *article_dimensions, "region"],
        {"_revenue": F.col("total_amount"), "_cost": F.col("quantity") * F.col("base_cost")},
        approximate,
    )
    totals = star_join(totals, calendar=calendar.select("date_key", *calendar_dimensions))
    revenue, cost = F.col("_revenue"), F.col("_cost")
    out = totals.select(
        "date",
        *calendar_dimensions,
        *article_dimensions,
        "region",
        "transaction_count",
        "total_units_sold",
        "unique_customers",
        money(revenue).alias("gross_revenue"),
        rounded_ratio(revenue, F.col("_rows")).alias("avg_transaction_value"),
        money(cost).alias("total_cost"),
        money(revenue - cost).alias("gross_profit"),
        rounded_ratio(revenue - cost, revenue, 100).alias("profit_margin_pct"),
        performance_band(revenue - cost, revenue).alias("performance_indicator"),
    )
    return with_audit(out, audit_ts, GOLD_SOURCE)


def category_performance(
    transactions: DataFrame, articles: DataFrame, audit_ts: datetime, approximate: bool = True
) -> DataFrame:
    """Transactions, units, customers, revenue, profit and ratios by day, category, region, channel."""
    joined = star_join(
        transactions, articles.select("article_id", "base_cost", "department", "category", "subcategory")
    )
    dimensions = ["department", "category", "subcategory", "region", "sales_channel"]
    totals = sales_totals(
        joined,
        [F.col("transaction_date").alias("sale_date"), *dimensions],
        {
            "_gross": F.col("total_amount"),
            "_net": F.col("net_amount"),
            "_cost": F.col("quantity") * F.col("base_cost"),
        },
        approximate,
    )
    gross, net, profit = F.col("_gross"), F.col("_net"), F.col("_net") - F.col("_cost")
    out = totals.select(
        "sale_date",
        *dimensions,
        "transaction_count",
        "total_units_sold",
        "unique_customers",
        money(gross).alias("gross_revenue"),
        money(net).alias("net_revenue"),
        rounded_ratio(gross, F.col("_rows")).alias("avg_transaction_value"),
        money(profit).alias("gross_profit"),
        rounded_ratio(profit, net, 100).alias("profit_margin_pct"),
        rounded_ratio(F.col("total_units_sold"), F.col("transaction_count")).alias("units_per_transaction"),
        rounded_ratio(net, F.col("unique_customers")).alias("revenue_per_customer"),
    )
    return with_audit(out, audit_ts, GOLD_SOURCE)


def sales_by_season(transactions: DataFrame, articles: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows and revenue by department and season, best first.

    Facts take the season of their day and combine by (season, article) before any shuffle, so what is
    shuffled grows with the articles and not with the days or lines.
    """
    seasonal = star_join(transactions, calendar=calendar.select("date_key", "retail_season"))
    by_article = seasonal.groupBy("retail_season", "article_id").agg(
        F.count(F.lit(1)).alias("_rows"), exact_sum(F.col("total_amount")).alias("_total")
    )
    return (
        star_join(by_article, articles.select("article_id", "department"))
        .groupBy("department", "retail_season")
        .agg(F.sum("_rows").alias("transaction_count"), F.sum("_total").cast("double").alias("total_revenue"))
        .orderBy(F.col("total_revenue").desc(), "department", "retail_season")
    )


def article_lookup(
    transactions: DataFrame, articles: DataFrame, order: Sequence[str], rows: int = 10, ahead: int = 100
) -> DataFrame:
    """First `rows` facts with their article, in a fixed order so that the result repeats.

    The first `rows` * `ahead` facts alone meet the articles: where they give enough rows, no later fact can come
    before those. Otherwise, as the plan finds by a subquery, all facts are joined; no fact is shuffled before.
    """
    ties = [c for c in ("article_id",) if c not in order]
    early = star_join(transactions.orderBy(*order, *ties).limit(rows * ahead), articles)
    enough = early.agg(F.count(F.lit(1)) >= rows).scalar()
    every = star_join(transactions.filter(~enough), articles)
    return early.filter(enough).unionByName(every).orderBy(*order).limit(rows)


def totals_per_entity(
    entities: DataFrame, key: str, facts: DataFrame, fact_key: str, amount: str
) -> DataFrame:
    """Every entity with its fact count and total, 0 when it has no facts.

    Facts are summed per key before the left join, so each key meets its entity once.
    """
    sums = facts.groupBy(F.col(fact_key).alias(key)).agg(
        F.count(F.lit(1)).alias("fact_count"), exact_sum(F.col(amount)).alias("_total")
    )
    return entities.join(sums, key, "left").select(
        *entities.columns,
        F.coalesce("fact_count", F.lit(0)).cast("bigint").alias("fact_count"),
        money(F.coalesce(F.col("_total"), F.lit(0))).alias("total_amount"),
    )


def flow_performance(event_log: DataFrame, as_of: date, audit_ts: datetime, days: int = 30) -> DataFrame:
    """Runs, durations, errors and health by day, pipeline, flow and dataset over the last days."""
    errors = F.count_if(F.col("level") == "ERROR")
    minutes = F.when(F.col("event_type") == "flow_progress", json_minutes(F.col("details")))
    out = (
        event_log.filter(recent(F.col("timestamp"), F.lit(as_of), days))
        .groupBy(
            F.to_date("timestamp").alias("date"),
            F.col("origin.pipeline_name").alias("pipeline_name"),
            F.col("origin.flow_name").alias("flow_name"),
            F.col("origin.dataset_name").alias("dataset_name"),
        )
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_distinct("origin.update_id").alias("update_count"),
            rounded_ratio(exact_sum(minutes), F.count(minutes)).alias("avg_duration_minutes"),
            errors.alias("error_count"),
            health_band(errors).alias("health_status"),
        )
    )
    return with_audit(out, audit_ts, "event_log")


def exploded_metrics(
    df: DataFrame,
    key: str,
    dimension: str,
    amount: str,
    array: str,
    element: str,
    noun: str,
    collect: str | None = None,
    key_is_unique: bool = False,
) -> DataFrame:
    """Metrics per array element and dimension; NULL arrays are left out.

    An element repeated in one array adds its amount twice to the total and its key once to the count.
    `collect` names a column of few values whose sorted set is shown per group.

    Where the key is unique, keys are counted inside the row: the array is sorted and the first of each run
    of equal elements is marked, so an element stays one row and no (element, key) pair is shuffled. The
    promise is checked on the key column, and a repeated key raises. A unique key has one value of
    `collect`, so groups are built by it first and the sets from few rows.
    """
    extra = [collect] if collect else []
    present = df.filter(F.col(array).isNotNull())
    count = f"{noun}_count"
    measures = [exact_sum(F.col(amount)).alias("_total"), F.count(amount).alias("_rows")]
    if key_is_unique:
        ordered = present.filter(_unique(df, key)).select(dimension, amount, *extra, F.sort_array(array).alias("_sorted"))
        placed = ordered.select(dimension, amount, *extra, "_sorted", F.posexplode("_sorted").alias("_at", element))
        again = F.col(element).eqNullSafe(F.get("_sorted", F.col("_at") - 1)) & (F.col("_at") > 0)
        marked = placed.select(dimension, amount, *extra, element, (~again).alias("_first"))
        grouped = marked.groupBy(element, dimension, *extra).agg(F.count_if("_first").alias(count), *measures)
        if collect:
            grouped = grouped.groupBy(element, dimension).agg(
                *[F.sum(c).alias(c) for c in (count, "_total", "_rows")], F.collect_set(collect).alias("_set")
            )
    else:
        exploded = present.select(key, dimension, amount, *extra, F.explode(array).alias(element))
        sets = [F.collect_set(collect).alias("_set")] if collect else []
        grouped = exploded.groupBy(element, dimension).agg(F.count_distinct(key).alias(count), *measures, *sets)
    total = F.col("_total")
    return grouped.select(
        element,
        dimension,
        count,
        money(total).alias("total_amount"),
        rounded_ratio(total, F.col("_rows")).alias("avg_amount"),
        *[F.array_sort("_set").alias(f"{c}_set") for c in extra],
    )


def _unique(df: DataFrame, key: str) -> Column:
    """A condition that is TRUE, or raises when a key repeats: a subquery over the key column alone."""
    repeats = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.count(F.lit(1))).scalar()
    message = F.raise_error(F.lit(f"{key} is not unique")).cast("boolean")
    return F.when(repeats > 0, message).otherwise(F.lit(True))

"""Data-quality rules, flags, quarantine reasons and key reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

CLEAN = "CLEAN"


@dataclass(frozen=True)
class Rule:
    """A condition rows must meet. A row passes only when it is TRUE, so NULL is a violation.

    `action` is "drop" or "fail". `on` says which side the condition reads: the "output" columns of a
    projection or its "input" columns (see `refine`).
    """

    name: str
    condition: str
    action: str = "drop"
    on: str = "output"

    def __post_init__(self):
        if self.action not in ("drop", "fail") or self.on not in ("input", "output"):
            raise ValueError(f"rule {self.name}: action is drop or fail, on is input or output")

    def passes(self) -> Column:
        return F.coalesce(F.expr(self.condition), F.lit(False))


def _both(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _keep(tests: Sequence[tuple[Rule, Column]]) -> Column:
    """Filter condition: fail rules raise before any drop rule is looked at.

    The error sits inside the filter, since an unused projected column would be pruned and never raise.
    """
    kept = _both([ok for rule, ok in tests if rule.action == "drop"])
    for rule, ok in reversed([t for t in tests if t[0].action == "fail"]):
        message = F.raise_error(F.lit(f"rule {rule.name} violated: {rule.condition}"))
        kept = F.when(~ok, message.cast("boolean")).otherwise(kept)
    return kept


def apply_rules(df: DataFrame, rules: Sequence[Rule], observation: Observation | None = None) -> DataFrame:
    """Drop or fail on the columns of `df`.

    Drop rules alone are a plain filter that reaches the file scan. With an `observation` the
    violations of each rule are counted in the same pass.
    """
    rules = list(rules)
    if not rules:
        return df
    if observation is not None:
        counts = [F.count_if(~r.passes()).alias(r.name) for r in rules]
        df = df.observe(observation, F.count(F.lit(1)).alias("rows"), *counts)
    if all(r.action == "drop" for r in rules):
        return df.filter(_both([F.expr(r.condition) for r in rules]))
    return df.filter(_keep([(r, r.passes()) for r in rules]))


def refine(
    df: DataFrame,
    outputs: Sequence[Column],
    rules: Sequence[Rule] = (),
    observation: Observation | None = None,
) -> DataFrame:
    """Project `outputs` and apply rules, each on the side it names."""
    inputs = [r for r in rules if r.on == "input"]
    marks = {r.name: f"_ok_{i}" for i, r in enumerate(inputs)}
    marked = df.select(*outputs, *[r.passes().alias(marks[r.name]) for r in inputs])
    tests = [(r, F.col(marks[r.name]) if r.on == "input" else r.passes()) for r in rules]
    if observation is not None:
        counts = [F.count_if(~ok).alias(r.name) for r, ok in tests]
        marked = marked.observe(observation, F.count(F.lit(1)).alias("rows"), *counts)
    if tests:
        marked = marked.filter(_keep(tests))
    return marked.drop(*marks.values())


def rule_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows `rule, action, violations, rows_checked`, from one aggregate over one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        *[F.count_if(~r.passes()).alias(f"_v{i}") for i, r in enumerate(rules)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.action).alias("action"),
                F.col(f"_v{i}").alias("violations"),
                F.col("rows_checked").alias("rows_checked"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return counts.select(F.inline(lines))


def first_match(cases: Sequence[tuple[str, Column]]) -> Column:
    """Label of the first condition that is TRUE, else NULL."""
    label = F.lit(None).cast("string")
    for name, condition in reversed(cases):
        label = F.when(condition, F.lit(name)).otherwise(label)
    return label


def quality_flag(cases: Sequence[tuple[str, Column]]) -> Column:
    """First problem of a row, or CLEAN."""
    return F.coalesce(first_match(cases), F.lit(CLEAN)).alias("data_quality_flag")


def split_rows(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected rows by a reason column; together they are exactly the input."""
    column = F.col(reason)
    return df.filter(column.isNull()).drop(reason), df.filter(column.isNotNull())


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a primary key: NULL in any part, or more than one row.

    Rows are counted per key before the shuffle, so copies of one key cost one row per task.
    """
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            *keys,
            "row_count",
            F.when(missing, "NULL_KEY").when(F.col("row_count") > 1, "DUPLICATE_KEY").alias("violation"),
        )
        .filter(F.col("violation").isNotNull())
    )


def orphan_report(fact: DataFrame, foreign_key: str, dimension: DataFrame, key: str) -> DataFrame:
    """Foreign-key values without a dimension row, with their number of fact rows.

    The fact is reduced to its distinct keys first: a hot key is one row in the join.
    """
    used = fact.filter(F.col(foreign_key).isNotNull()).groupBy(foreign_key).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    known = dimension.select(F.col(key).alias(foreign_key))
    return used.join(known, foreign_key, "left_anti")


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows `column_name, null_count, rows_checked` for declared NOT NULL columns, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_n{i}").alias("null_count"),
                F.col("rows_checked").alias("rows_checked"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return counts.select(F.inline(lines))

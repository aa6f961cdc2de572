"""Run a registered query and its SQL side by side and compare rows without order."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def rows(df) -> list[tuple]:
    """All rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, date) and not isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    return value


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, db, sql: str) -> str | None:
    """None when both sides are equal, else what differs."""
    relation = db.sql(sql)
    want_columns, want = rows_by_name(list(relation.columns), relation.fetchall())
    have_columns, have = rows_by_name(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if have_columns != want_columns:
        return f"columns {have_columns} != {want_columns}"
    if have != want:
        return (
            f"rows {sum(have.values())} / {sum(want.values())}; only Spark {list((have - want).items())[:2]}; "
            f"only SQL {list((want - have).items())[:2]}; differing {sum((have - want).values())}"
        )
    return None

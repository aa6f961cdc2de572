"""Slowly changing dimensions from a change log.

Both types read the log, never another history table. The order of versions is the business
sequence with a tie-break, so arrival order does not matter.

One key may hold a large share of all rows. Type 1 is an aggregate that combines before the shuffle.
Type 2 needs the next version of a row; a window by key alone would put a hot key in one task. So the
sequence is cut into slices by fixed rules of its type (see `slices`), each coarser than the one
before, and a row looks for its neighbour in its slice. Where a slice ends, the neighbour is the edge
of the next slice: edges are one row a slice, find their neighbours in the next coarser slices in the
same way, and join the window of their slice as one more row. Every key takes this one plan, nothing is
counted or sampled for it, and it holds no joins. With one row a (key, sequence), a window over an
integer sequence has at most 2**24 rows, whatever the data; a window over times has the rows of a key
in about a minute, or at most 2**19 edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "__START_AT", "__END_AT"
CONTROL_COLUMNS = ("cdc_operation", "cdc_timestamp", "cdc_timestamp_ms")


def latest_rows(changes: DataFrame, keys: Sequence[str], sequence: str, tie: Sequence[str] = ()) -> DataFrame:
    """Latest row per key, deletes included; on a stream this is one row of state a key."""
    rest = F.struct(*[c for c in changes.columns if c not in keys])
    last = F.max_by(rest, F.struct(sequence, *tie)).alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*changes.columns)


def scd1(
    changes: DataFrame,
    keys: Sequence[str],
    sequence: str,
    tie: Sequence[str] = (),
    operation: str | None = "cdc_operation",
    exclude: Sequence[str] = CONTROL_COLUMNS,
    keep_tombstones: bool = False,
) -> DataFrame:
    """Latest row per key. A key whose latest row is a delete is absent, or kept as a tombstone."""
    latest = latest_rows(changes, keys, sequence, tie)
    if keep_tombstones:
        return latest
    if operation:
        latest = latest.filter(~F.col(operation).eqNullSafe("d"))
    return latest.drop(*exclude)


def scd2(
    changes: DataFrame,
    keys: Sequence[str],
    sequence: str,
    tie: Sequence[str] = (),
    operation: str | None = "cdc_operation",
    exclude: Sequence[str] = CONTROL_COLUMNS,
    collapse_unchanged: bool = False,
    untracked: Sequence[str] = ("audit_ts", "source_system"),
) -> DataFrame:
    """One row per version with `__START_AT` and `__END_AT` (NULL while open).

    Rows with an equal (key, sequence) are one version, the highest tie-break wins. A delete closes
    the version before it and has no row itself. With `collapse_unchanged` a version equal to its
    predecessor in all tracked columns is merged into it. Rows with a NULL key belong in quarantine.
    """
    cuts = slices(changes.schema[sequence].dataType, F.col(sequence))
    levels = [f"_slice_{i}" for i in range(len(cuts))]
    log = changes.withColumns(dict(zip(levels, cuts)))
    versions = one_per_sequence(log, keys, sequence, tie, levels)
    edges = log
    if collapse_unchanged:
        skipped = {*keys, sequence, *tie, *exclude, *untracked}
        state = F.struct(
            *[F.coalesce(F.col(operation) == "d", F.lit(False)).alias("_gone")] if operation else [],
            *[c for c in changes.columns if c not in skipped],
        )
        order = F.struct(sequence, *_tie_columns(changes, keys, sequence, tie))
        last = log.groupBy(*keys, *levels).agg(F.max_by(state, order).alias("_edge")) if levels else None
        versions = _neighbour(versions, last, keys, levels, sequence, state, "_previous", step=-1)
        versions = versions.filter(F.col("_previous").isNull() | ~state.eqNullSafe(F.col("_previous")))
        edges = versions = versions.drop("_previous")
    first = edges.groupBy(*keys, *levels).agg(F.min(sequence).alias("_edge")) if levels else None
    versions = _neighbour(versions, first, keys, levels, sequence, F.col(sequence), END, step=1)
    if operation:
        versions = versions.filter(~F.col(operation).eqNullSafe("d"))
    payload = [c for c in changes.columns if c not in exclude]
    return versions.select(*payload, F.col(sequence).alias(START), END)


def slices(kind: T.DataType, value: Column) -> list[Column]:
    """Slices of an ordered value, finest first: each rises with the value and follows from the one before.

    Whole numbers: blocks of 2**16, then of 2**40. Times: 2**26 microseconds (67 seconds), then 2**45
    (13 months). Text: its first 16, then 8 characters. A struct goes by its fields in turn. Dates and
    small types need none, as few values exist.
    """
    if isinstance(kind, T.StructType):
        first, *rest = kind.fields
        out = slices(first.dataType, value[first.name])
        if rest:
            tail = F.struct(*[value[f.name].alias(f.name) for f in rest])
            inner = slices(T.StructType(rest), tail)
            out = [F.struct(value[first.name].alias("a"), c.alias("b")) for c in inner] + [value[first.name], *out]
        return out
    if isinstance(kind, T.LongType):
        return [F.shiftright(value, 16), F.shiftright(value, 40)]
    if isinstance(kind, T.IntegerType):
        return [F.shiftright(value, 16)]
    if isinstance(kind, T.TimestampType):
        return [F.shiftright(F.unix_micros(value), 26), F.shiftright(F.unix_micros(value), 45)]
    if isinstance(kind, T.TimestampNTZType):
        day = value.cast("date")
        return [F.struct(day.alias("a"), (F.hour(value) * 60 + F.minute(value)).alias("b")), day]
    if isinstance(kind, T.StringType):
        return [F.substring(value, 1, 16), F.substring(value, 1, 8)]
    if isinstance(kind, T.DecimalType):
        return [F.floor(value / F.lit(1 << 16)), F.floor(value / F.lit(1 << 40))]
    if isinstance(kind, T.FractionalType):
        return [F.when(F.abs(value) < float("inf"), value - value % float(1 << 16)).otherwise(value)]
    return []


def _tie_columns(df: DataFrame, keys: Sequence[str], sequence: str, tie: Sequence[str]) -> list[str]:
    return list(tie) or sorted(c for c in df.columns if c not in {*keys, sequence})


def one_per_sequence(
    df: DataFrame, keys: Sequence[str], sequence: str, tie: Sequence[str], levels: Sequence[str] = ()
) -> DataFrame:
    """One row per (key, sequence); copies are merged before the shuffle. `levels` follow from the sequence."""
    ids = [*keys, *levels, sequence]
    rest = [c for c in df.columns if c not in ids]
    order = F.struct(*_tie_columns(df.drop(*levels), keys, sequence, tie))
    return df.groupBy(*ids).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*ids, "_row.*")


def _neighbour(
    df: DataFrame,
    edges: DataFrame | None,
    keys: Sequence[str],
    levels: Sequence[str],
    order: str,
    value: Column,
    target: str,
    step: int,
) -> DataFrame:
    """Add `target`: the value in the next (1) or previous (-1) row of the key by `order`.

    `edges` has, for each slice of a key, the value of its first (1) or last (-1) row as `_edge`.
    """
    look = F.lead if step > 0 else F.lag
    if edges is None:
        return df.withColumn(target, look(value, 1).over(Window.partitionBy(*keys).orderBy(order)))
    rows = df.withColumn("_value", value).withColumn("_side", F.lit(0))
    # a slice's edge beyond stands behind (1) or before (-1) all its rows
    beyond = _edges_beyond(edges, keys, levels, step).select(
        *keys, *levels, F.col("_edge").alias("_value"), F.lit(step).alias("_side")
    )
    window = Window.partitionBy(*keys, levels[0]).orderBy("_side", order)
    both = rows.unionByName(beyond, allowMissingColumns=True)
    return both.withColumn(target, look("_value", 1).over(window)).filter("_side = 0").drop("_value", "_side")


def _edges_beyond(edges: DataFrame, keys: Sequence[str], levels: Sequence[str], step: int) -> DataFrame:
    """For each slice the edge of the next (1) or previous (-1) slice of its key, found level by level."""
    if len(levels) == 1:
        coarser = None
    else:
        near = F.min_by if step > 0 else F.max_by
        coarser = edges.groupBy(*keys, *levels[1:]).agg(near("_edge", levels[0]).alias("_edge"))
    moved = _neighbour(edges, coarser, keys, levels[1:], levels[0], F.col("_edge"), "_next", step)
    return moved.drop("_edge").withColumnRenamed("_next", "_edge")

"""Change events: envelope, quarantine, typed changes, change feed between two versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.operators.bronze import with_audit
from stratiform.operators.quality import first_match, split_rows

# Operation codes and quarantine reasons.
OPERATIONS = ("c", "u", "d", "r")
DELETE = "d"
NULL_PRIMARY_KEY = "NULL_PRIMARY_KEY"
INVALID_CDC_OPERATION = "INVALID_CDC_OPERATION"
SCHEMA_MISMATCH = "SCHEMA_MISMATCH"

_ENVELOPE = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("_bad", T.StringType()),
    ]
)


def _unknown_fields(text: Column, schema: T.StructType) -> Column:
    """True when JSON text has a field the schema lacks, nested structs included."""
    known = F.array(*[F.lit(n) for n in schema.names])
    found = F.size(F.array_except(F.json_object_keys(text), known)) > 0
    unknown = F.coalesce(found, F.lit(False))
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            unknown = unknown | _unknown_fields(
                F.get_json_object(text, f"$['{field.name}']"), field.dataType
            )
    return unknown


def parse_changes(
    lines: DataFrame, payload: T.StructType, text: str = "value", delete_image: str = "before"
) -> DataFrame:
    """Change events from JSON text: payload columns, operation, event time, rescued text.

    A delete has no `after` image, so its key and payload come from `before`; `delete_image="after"`
    reads `after` alone. `_rescued_data` holds the line when it is not JSON, a value has the wrong
    type or a field is unknown. Images are parsed as text first, so each is parsed only once.
    """
    raw = F.col(text)
    others = [c for c in lines.columns if c != text]
    envelope = F.from_json(raw, _ENVELOPE, {"columnNameOfCorruptRecord": "_bad"})
    # inline of a one-element array keeps the parse in one step: a plain struct column would be parsed
    # again for every field taken from it
    df = lines.select(*others, raw.alias("_line"), F.inline(F.array(envelope)))
    image = F.col("after")
    if delete_image == "before":
        image = F.when(F.col("op") == DELETE, F.coalesce(image, F.col("before"))).otherwise(image)
    with_bad = T.StructType([*payload.fields, T.StructField("_bad_image", T.StringType())])
    row = F.from_json(F.col("_image"), with_bad, {"columnNameOfCorruptRecord": "_bad_image"})
    df = df.select(
        *others,
        "_line",
        F.col("_bad").isNotNull().alias("_bad"),
        F.col("op").alias("cdc_operation"),
        F.col("ts_ms").alias("cdc_timestamp_ms"),
        image.alias("_image"),
    ).select("*", F.inline(F.array(row)))
    mismatch = (
        F.col("_bad")
        | F.col("_bad_image").isNotNull()
        | _unknown_fields(F.col("_line"), T.StructType(_ENVELOPE.fields[:4]))
        | _unknown_fields(F.col("_image"), payload)
    )
    return df.select(
        *payload.names,
        "cdc_operation",
        "cdc_timestamp_ms",
        *others,
        F.when(mismatch, F.col("_line")).alias("_rescued_data"),
    )


def reject_reason(keys: Sequence[str]) -> Column:
    """Why a change row is rejected, NULL for a valid row; a NULL operation is an invalid one."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    valid_op = F.coalesce(F.col("cdc_operation").isin(*OPERATIONS), F.lit(False))
    return first_match(
        [
            (NULL_PRIMARY_KEY, missing),
            (INVALID_CDC_OPERATION, ~valid_op),
            (SCHEMA_MISMATCH, F.col("_rescued_data").isNotNull()),
        ]
    )


def classify_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return changes.withColumn("quarantine_reason", reject_reason(keys))


def split_changes(
    classified: DataFrame, audit_ts: datetime, source_system: str
) -> tuple[DataFrame, DataFrame]:
    """Valid changes, and rejected ones with reason and time; the two are exactly the input."""
    valid, rejected = split_rows(classified, "quarantine_reason")
    rejected = rejected.withColumn("quarantined_at", F.lit(audit_ts).cast("timestamp"))
    return (
        with_audit(valid.drop("_rescued_data"), audit_ts, source_system),
        with_audit(rejected, audit_ts, source_system),
    )


def reason_counts(classified: DataFrame) -> DataFrame:
    """Rows per outcome, with VALID for the accepted ones."""
    return classified.groupBy(F.coalesce("quarantine_reason", F.lit("VALID")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


def event_time(ms: str = "cdc_timestamp_ms") -> Column:
    """Epoch milliseconds as a timestamp, milliseconds kept."""
    return F.timestamp_millis(F.col(ms))


def typed_changes(
    changes: DataFrame, casts: Mapping[str, str], keep_deletes: bool = True
) -> DataFrame:
    """Change rows with cast payload columns and `cdc_timestamp`; deletes can be left out."""
    if not keep_deletes:
        changes = changes.filter(F.col("cdc_operation") != DELETE)
    columns = [
        F.col(c).try_cast(casts[c]).alias(c) if c in casts else F.col(c)
        for c in changes.columns
        if c != "cdc_timestamp_ms"
    ]
    return changes.select(*columns, event_time().alias("cdc_timestamp"))


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row changes between two versions of a keyed table.

    `_change_type` is insert, update_before, update_after or delete. One full join on the key; the
    key is unique in both versions, so no key is hot.
    """
    columns = new.columns
    values = [c for c in columns if c not in keys]
    left = old.select(*keys, F.struct(*columns).alias("_old"))
    right = new.select(*keys, F.struct(*columns).alias("_new"))
    joined = left.join(right, list(keys), "full")

    def line(kind: str, side: str) -> Column:
        return F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in columns], F.lit(kind).alias("_change_type"))

    same = F.lit(True)
    for c in values:
        same = same & F.col(f"_old.`{c}`").eqNullSafe(F.col(f"_new.`{c}`"))
    changes = (
        F.when(F.col("_old").isNull(), F.array(line("insert", "_new")))
        .when(F.col("_new").isNull(), F.array(line("delete", "_old")))
        .when(~same, F.array(line("update_before", "_old"), line("update_after", "_new")))
    )
    return joined.select(F.inline(changes))

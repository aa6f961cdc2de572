import json

from compare import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.operators.cdc import (
    change_feed,
    classify_changes,
    event_time,
    parse_changes,
    reason_counts,
    split_changes,
    typed_changes,
)

PAYLOAD = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("home", T.StructType([T.StructField("city", T.StringType())])),
    ]
)


def event(op, after=None, before=None, **more):
    body = {"op": op, "ts_ms": 1700000000123, "before": before, "after": after, **more}
    return json.dumps({k: v for k, v in body.items() if k != "op" or v is not None})


CASES = {
    "create": (event("c", {"id": 1, "name": "a"}), None),
    "update": (event("u", {"id": 1, "name": "b", "home": {"city": "x"}}), None),
    "read": (event("r", {"id": 1}), None),
    "delete": (event("d", None, {"id": 1, "name": "b"}), None),
    "no key": (event("c", {"name": "a"}), "NULL_PRIMARY_KEY"),
    "no key and bad op": (event("x", {"name": "a"}), "NULL_PRIMARY_KEY"),
    "bad op": (event("x", {"id": 1}), "INVALID_CDC_OPERATION"),
    "no op": (event(None, {"id": 1}), "INVALID_CDC_OPERATION"),
    "wrong type": (event("c", {"id": 1, "home": 5}), "SCHEMA_MISMATCH"),
    "unknown field": (event("c", {"id": 1, "age": 3}), "SCHEMA_MISMATCH"),
    "unknown nested field": (event("c", {"id": 1, "home": {"city": "x", "zip": 1}}), "SCHEMA_MISMATCH"),
    "unknown outer field": (event("c", {"id": 1}, extra=1), "SCHEMA_MISMATCH"),
    "wrong key type": (event("c", {"id": "one"}), "NULL_PRIMARY_KEY"),
    "not json": ("{broken", "NULL_PRIMARY_KEY"),
}


def lines(spark):
    return spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "label string, value string")


def test_reasons(spark):
    out = classify_changes(parse_changes(lines(spark), PAYLOAD), ["id"])
    assert {r["label"]: r["quarantine_reason"] for r in out.collect()} == {k: v[1] for k, v in CASES.items()}


def test_rescued_text_is_the_line(spark):
    out = parse_changes(lines(spark), PAYLOAD).filter(F.col("label") == "unknown field").first()
    assert out["_rescued_data"] == CASES["unknown field"][0]
    assert out["id"] == 1


def test_after_image_only(spark):
    out = classify_changes(parse_changes(lines(spark), PAYLOAD, delete_image="after"), ["id"])
    assert out.filter(F.col("label") == "delete").first()["quarantine_reason"] == "NULL_PRIMARY_KEY"


def test_split_keeps_every_row(spark, audit_ts):
    classified = classify_changes(parse_changes(lines(spark), PAYLOAD), ["id"])
    valid, rejected = split_changes(classified, audit_ts, "pos")
    assert valid.count() == 4 and rejected.count() == len(CASES) - 4
    assert valid.columns[-2:] == rejected.columns[-2:] == ["audit_ts", "source_system"]
    counts = {r.outcome: r.row_count for r in reason_counts(classified).collect()}
    assert counts["VALID"] == 4 and sum(counts.values()) == len(CASES)


def test_milliseconds_are_kept(spark):
    out = parse_changes(lines(spark), PAYLOAD).select(event_time().alias("t")).filter("t IS NOT NULL").first()
    assert out.t.microsecond == 123000


def test_typed_changes(spark):
    typed = typed_changes(parse_changes(lines(spark), PAYLOAD), {"id": "string"}, keep_deletes=False)
    assert dict(typed.dtypes)["id"] == "string" and dict(typed.dtypes)["cdc_timestamp"] == "timestamp"
    assert typed.filter(F.col("cdc_operation") == "d").count() == 0


def test_change_feed_turns_old_into_new(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "id int, v string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", 1)], "id int, v string, n int")
    feed = change_feed(old, new, ["id"])
    assert rows(feed) == [
        (2, "b", 1, "update_before"),
        (2, "b", None, "update_after"),
        (3, "c", 1, "delete"),
        (4, "d", 1, "insert"),
    ]
    gone = feed.filter(F.col("_change_type").isin("delete", "update_before")).select("id")
    come = feed.filter(F.col("_change_type").isin("insert", "update_after")).drop("_change_type")
    assert rows(old.join(gone, "id", "left_anti").unionByName(come)) == rows(new)


def test_change_feed_of_equal_versions_is_empty(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    assert change_feed(df, df, ["id"]).count() == 0

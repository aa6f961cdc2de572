import json
import random

import pytest
from compare import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.operators.cdc import parse_changes
from stratiform.operators.gold import daily_fold, daily_parts, daily_summary
from stratiform.operators.history import scd1, scd2
from stratiform.operators.silver import silver_transactions
from stratiform.session import work_folder
from stratiform.sources.files import read_stream
from stratiform.streaming import ingest, state
from test_history import SCHEMA, random_log

KEYS = ["id"]
CONTROL = ("cdc_operation", "seq", "n")


def changes(spark, events):
    return spark.createDataFrame(events, SCHEMA)


def batches(seed):
    """A change log in random pieces: rows arrive late and keys are deleted and come back."""
    events = random_log(seed, size=300)
    random.Random(seed + 1).shuffle(events)
    return [events[:50], events[50:60], events[60:]], events


def test_only_new_files_are_read(spark, audit_ts):
    folder = work_folder(spark, "ingest")

    def run():
        stream = read_stream(spark, "json", "id long, v string", f"{folder}/in")
        raw = ingest.bronze_stream(stream, ["id"], audit_ts, "pos")
        query = ingest.append(raw, f"{folder}/out", f"{folder}/checkpoint")
        query.awaitTermination()
        return sum(p.numInputRows for p in query.recentProgress)

    spark.createDataFrame([(1, "a"), (None, "b")], "id long, v string").write.json(f"{folder}/in")
    assert run() == 2 and run() == 0
    spark.createDataFrame([(2, "c")], "id long, v string").write.mode("append").json(f"{folder}/in")
    assert run() == 1
    out = spark.read.parquet(f"{folder}/out")
    assert out.columns == ["id", "v", "_source_file", "audit_ts", "source_system"]
    assert rows(out.select("id", "v")) == [(1, "a"), (2, "c")]
    assert out.filter(F.contains("_source_file", F.lit("in/part-"))).count() == 2


def test_validation_on_a_stream(spark, audit_ts):
    schema = "transaction_id string, article_id string, quantity string, unit_price double, total_amount double"
    folder = work_folder(spark, "silver")
    data = [(" t1 ", "a", "2", 1.0, 2.0), ("t2", "a", "0", 1.0, 2.0), ("t3", "a", "x", 1.0, 2.0), ("t4", "a", "1", -1.0, 2.0)]
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/in")
    stream = silver_transactions(read_stream(spark, "parquet", schema, f"{folder}/in"), audit_ts)
    ingest.append(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    batch = silver_transactions(spark.createDataFrame(data, schema), audit_ts)
    assert rows(spark.read.parquet(f"{folder}/out")) == rows(batch)
    assert batch.count() == 1


def test_counts_of_violations_in_a_batch(spark, audit_ts):
    schema = "transaction_id string, article_id string, quantity string, unit_price double, total_amount double"
    seen = Observation("silver")
    data = [("t1", "a", "2", 1.0, 2.0), ("t2", "a", "0", 1.0, 2.0), ("t3", "a", "x", 1.0, -2.0)]
    silver_transactions(spark.createDataFrame(data, schema), audit_ts, seen).collect()
    assert seen.get["rows"] == 3 and seen.get["valid_quantity"] == 2 and seen.get["valid_amounts"] == 1


def test_fail_rule_stops_the_stream(spark, audit_ts):
    schema = "transaction_id string, article_id string, quantity string, unit_price double, total_amount double"
    folder = work_folder(spark, "silver")
    spark.createDataFrame([(None, "a", "2", 1.0, 2.0)], schema).write.parquet(f"{folder}/in")
    stream = silver_transactions(read_stream(spark, "parquet", schema, f"{folder}/in"), audit_ts)
    query = ingest.append(stream, f"{folder}/out", f"{folder}/checkpoint")
    with pytest.raises(Exception, match="valid_transaction_id"):
        query.awaitTermination()
    with pytest.raises(Exception, match="(?i)unable to infer|UNABLE_TO_INFER|PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/out").count()


def test_quarantine_can_run_twice(spark, audit_ts):
    folder = work_folder(spark, "quarantine")
    payload = T.StructType([T.StructField("id", T.LongType())])
    lines = [json.dumps({"op": op, "ts_ms": 1, "after": {"id": i}}) for op, i in [("c", 1), ("x", 2), ("u", None)]]
    parsed = parse_changes(spark.createDataFrame([(v,) for v in lines], "value string"), payload)
    for _ in range(2):
        ingest.quarantine_batch(parsed, 0, folder, ["id"], audit_ts, "pos")
    assert spark.read.parquet(f"{folder}/valid").count() == 1
    rejected = spark.read.parquet(f"{folder}/rejected").select("quarantine_reason")
    assert rows(rejected) == [("INVALID_CDC_OPERATION",), ("NULL_PRIMARY_KEY",)]


BY = (KEYS, "seq", ["n"])


def feed(spark, kind, pieces, path, checkpoint, files):
    """Each piece arrives as a file and the stream starts anew on its checkpoint; returns the batches that ran."""
    ran = 0
    for piece in pieces:
        changes(spark, piece).coalesce(1).write.mode("append").parquet(files)
        stream = read_stream(spark, "parquet", changes(spark, []).schema, files, maxFilesPerTrigger="1")
        query = (state.scd1_stream if kind == "scd1" else state.scd2_stream)(stream, path, checkpoint, *BY)
        query.awaitTermination()
        ran += sum(p.numInputRows > 0 for p in query.recentProgress)
    return ran


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("kind", ["scd1", "scd2"])
def test_kept_results_equal_batch(spark, kind, seed):
    folder = work_folder(spark, kind)
    pieces, events = batches(seed)
    out, schema = f"{folder}/out", changes(spark, []).schema
    assert feed(spark, kind, pieces, out, f"{folder}/checkpoint", f"{folder}/in") == len(pieces)
    read, fold = (state.scd1_state, scd1) if kind == "scd1" else (state.scd2_state, scd2)
    want = rows(fold(changes(spark, events), *BY, exclude=CONTROL))
    assert rows(read(spark, out, schema, *BY, exclude=CONTROL)) == want
    # a batch that runs again writes its own folder, whatever a first run left there
    again = state.read_batches(spark, out, schema).filter("batch = 1").drop("batch").collect()
    state.write_batch(spark.createDataFrame(again[:3], schema), 1, out)
    state.write_batch(spark.createDataFrame(again, schema), 1, out)
    assert rows(read(spark, out, schema, *BY, exclude=CONTROL)) == want


@pytest.mark.parametrize("kind", ["scd1", "scd2"])
def test_a_batch_writes_what_it_brings(spark, kind):
    """The third batch brings two rows to a table of 50 keys and writes two rows."""
    folder = work_folder(spark, kind)
    first = [(i, "a", "c", 1, i) for i in range(50)]
    pieces = [first, [(1, "b", "u", 5, 100)], [(2, "late", "u", 0, 101), (3, "b", "d", 9, 102)]]
    feed(spark, kind, pieces, f"{folder}/out", f"{folder}/checkpoint", f"{folder}/in")
    written = state.read_batches(spark, f"{folder}/out", changes(spark, []).schema)
    assert rows(written.groupBy("batch").count().select("count")) == [(1,), (2,), (50,)]


def test_late_row_does_not_revive_a_key(spark):
    folder = work_folder(spark, "scd1")
    pieces = [[(1, "a", "d", 9, 1)], [(1, "late", "u", 5, 2)]]
    feed(spark, "scd1", pieces, f"{folder}/out", f"{folder}/checkpoint", f"{folder}/in")
    assert state.scd1_state(spark, f"{folder}/out", changes(spark, []).schema, *BY).count() == 0


def test_overruled_version_disappears(spark):
    """A later tie-break turns the only version of a key into a delete."""
    folder = work_folder(spark, "scd2")
    pieces = [[(1, "a", "c", 1, 1)], [(1, "a", "d", 1, 2)]]
    feed(spark, "scd2", pieces, f"{folder}/out", f"{folder}/checkpoint", f"{folder}/in")
    assert state.scd2_state(spark, f"{folder}/out", changes(spark, []).schema, *BY, exclude=CONTROL).count() == 0


def test_nothing_is_kept_before_the_first_batch(spark):
    schema = changes(spark, []).schema
    assert state.scd1_state(spark, work_folder(spark, "none"), schema, *BY).count() == 0


MEASURES = "ts timestamp, dim string, who int, amount double, data_quality_flag string"


def summary(df, audit_ts, **options):
    return daily_summary(
        df, F.col("ts"), ["dim"], "who", "user", "amount", F.col("amount") > 0, audit_ts, **options
    )


@pytest.fixture
def measures(spark):
    folder = work_folder(spark, "daily")
    parts = []
    for i in range(3):
        part = spark.range(40).select(
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 5000 + i * 40000).alias("ts"),
            F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("dim"),
            (F.col("id") % 5).cast("int").alias("who"),
            (F.col("id") * 1.1 - 3).alias("amount"),
            F.when(F.col("id") % 4 == 0, "BAD").otherwise("CLEAN").alias("data_quality_flag"),
        )
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        parts.append(part)
    return folder, parts[0].unionByName(parts[1]).unionByName(parts[2])


def test_kept_parts_fold_to_the_summary(spark, measures, audit_ts):
    folder, whole = measures
    by = (F.col("ts"), ["dim"], "who", "amount", F.col("amount") > 0)
    for _ in range(2):
        stream = read_stream(spark, "parquet", whole.schema, f"{folder}/in", maxFilesPerTrigger="1")
        parts = daily_parts(stream, *by)
        state.aggregate_stream(parts, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    kept = state.aggregate_state(spark, f"{folder}/out", parts.schema, ["date", "dim", "who"])
    have = daily_fold(kept, ["dim"], "who", "user", audit_ts)
    want = summary(whole, audit_ts, approximate=False)
    assert have.columns == want.columns and rows(have) == rows(want)
    assert "unique_users" in have.columns


def test_watermark_allows_append(spark, measures, audit_ts):
    folder, whole = measures
    stream = read_stream(spark, "parquet", whole.schema, f"{folder}/in")
    closed = summary(stream, audit_ts, watermark="1 hour")
    ingest.append(closed, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    have = rows(spark.read.parquet(f"{folder}/out").select("date", "dim", "user_count", "total_amount"))
    want = rows(summary(whole, audit_ts).select("date", "dim", "user_count", "total_amount"))
    assert have and set(have) < set(want)
    assert rows(summary(whole, audit_ts, watermark="1 hour")) == rows(summary(whole, audit_ts))

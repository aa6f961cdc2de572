import random

import pytest
from compare import rows
from pyspark.sql import functions as F

from stratiform.operators.history import scd1, scd2

SCHEMA = "id int, v string, cdc_operation string, seq int, n int"


def log(spark, *events):
    return spark.createDataFrame(list(events), SCHEMA)


def current(df):
    return rows(scd1(df, ["id"], "seq", ["n"], exclude=("cdc_operation", "seq", "n")))


def versions(df, **options):
    return rows(scd2(df, ["id"], "seq", ["n"], exclude=("cdc_operation", "seq", "n"), **options))


def test_latest_row_wins_whatever_the_arrival(spark):
    df = log(spark, (1, "new", "u", 9, 2), (1, "old", "c", 1, 1))
    assert current(df) == [(1, "new")]


def test_tie_break(spark):
    df = log(spark, (1, "first", "u", 5, 1), (1, "second", "u", 5, 2))
    assert current(df) == [(1, "second")]
    assert versions(df) == [(1, "second", 5, None)]


def test_delete_and_insert_again(spark):
    df = log(spark, (1, "a", "c", 1, 1), (1, "a", "d", 3, 2), (1, "b", "c", 5, 3))
    assert current(df) == [(1, "b")]
    assert versions(df) == [(1, "a", 1, 3), (1, "b", 5, None)]


def test_deleted_key_is_absent(spark):
    df = log(spark, (1, "a", "c", 1, 1), (1, "a", "d", 3, 2))
    assert current(df) == []
    assert versions(df) == [(1, "a", 1, 3)]


def test_delete_of_unknown_key(spark):
    df = log(spark, (7, "x", "d", 1, 1))
    assert current(df) == [] and versions(df) == []


def test_late_update_stays_under_the_delete(spark):
    df = log(spark, (1, "a", "d", 9, 2), (1, "late", "u", 5, 3))
    assert current(df) == []
    assert versions(df) == [(1, "late", 5, 9)]


def test_empty(spark):
    assert current(log(spark)) == [] and versions(log(spark)) == []


def test_exact_copies_count_once(spark):
    df = log(spark, *[(1, "a", "c", 1, 1)] * 5)
    assert versions(df) == [(1, "a", 1, None)]


def test_unchanged_versions_merge_on_request(spark):
    df = log(
        spark,
        (1, "a", "c", 1, 1),
        (1, "a", "u", 2, 2),
        (1, "b", "u", 3, 3),
        (1, "b", "d", 4, 4),
        (1, "b", "c", 5, 5),
        (1, "b", "u", 6, 6),
    )
    assert len(versions(df)) == 5
    assert versions(df, collapse_unchanged=True) == [
        (1, "a", 1, 3),
        (1, "b", 3, 4),
        (1, "b", 5, None),
    ]


def random_log(seed, size=600, hot=0.4):
    pick = random.Random(seed)
    out = []
    for n in range(size):
        key = 0 if pick.random() < hot else pick.randrange(1, 30)
        out.append((key, pick.choice("abc"), pick.choice("cuuuurd"), pick.randrange(200), n))
    return out


def simple_history(events):
    """Brute force: per key, one row per sequence, each ending where the next begins."""
    best = {}
    for key, v, op, seq, n in events:
        if (key, seq) not in best or best[key, seq][2] < n:
            best[key, seq] = (v, op, n)
    out = []
    for (key, seq), (v, op, _) in best.items():
        later = [s for k, s in best if k == key and s > seq]
        if op != "d":
            out.append((key, v, seq, min(later) if later else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_brute_force(spark, seed):
    events = random_log(seed)
    want = simple_history(events)
    assert versions(log(spark, *events)) == want
    random.Random(9).shuffle(events)
    assert versions(log(spark, *events)) == want


def simple_collapsed(events):
    """Brute force: versions whose value and presence equal those of the version before are left out."""
    best = {}
    for key, v, op, seq, n in events:
        if (key, seq) not in best or best[key, seq][2] < n:
            best[key, seq] = (v, op == "d", n)
    out, kept = [], {}
    for (key, seq), (v, gone, _) in sorted(best.items(), key=lambda x: x[0]):
        if kept.get(key, [None])[-1] is None or kept[key][-1][1:] != (v, gone):
            kept.setdefault(key, []).append((seq, v, gone))
    for key, chain in kept.items():
        for i, (seq, v, gone) in enumerate(chain):
            if not gone:
                out.append((key, v, seq, chain[i + 1][0] if i + 1 < len(chain) else None))
    return sorted(out, key=repr)


# sequences of every kind, spread so that slices of all levels hold one, few and many rows
SEQUENCES = {
    "bigint": "CASE WHEN seq < 60 THEN seq WHEN seq < 120 THEN seq * 70000L ELSE seq * 900000000000L END - 500",
    "int": "CAST(CASE WHEN seq < 60 THEN seq ELSE seq * 70000 END AS INT)",
    "timestamp": "timestamp_micros(CASE WHEN seq < 60 THEN seq WHEN seq < 120 THEN seq * 40000000L ELSE seq * 9000000000000L END)",
    "timestamp_ntz": "CAST(timestamp_micros(CASE WHEN seq < 60 THEN seq ELSE seq * 40000000L END) AS TIMESTAMP_NTZ)",
    "date": "date_add(DATE'1970-01-01', seq)",
    "string": "CONCAT(CASE WHEN seq < 60 THEN 'a' WHEN seq < 120 THEN 'b-long-prefix-of-all' ELSE CONCAT('c', seq) END, LPAD(seq, 6, '0'))",
    "decimal": "CAST(CASE WHEN seq < 60 THEN seq ELSE seq * 70000.5 END AS DECIMAL(20,2))",
    "double": "CAST(CASE WHEN seq < 60 THEN seq - 30 WHEN seq < 190 THEN seq * 70000.5 ELSE seq * 1e200 END AS DOUBLE)",
    "struct": "named_struct('day', CAST(seq / 50 AS INT), 'n', CAST(seq AS BIGINT) * 30000)",
    "struct_of_text": "named_struct('t', timestamp_seconds(CAST(seq / 3 AS BIGINT) * 60), 's', LPAD(seq, 12, '0'), 'i', seq)",
}


@pytest.mark.parametrize("kind", sorted(SEQUENCES))
@pytest.mark.parametrize("collapse", [False, True])
def test_sequences_of_every_kind(spark, kind, collapse):
    """The order of versions is that of the whole number behind the sequence, so its history is the same."""
    events = random_log(3)
    df = log(spark, *events).withColumn("rank", F.col("seq")).withColumn("seq", F.expr(SEQUENCES[kind]))
    names = df.select("seq", "rank").distinct()
    have = scd2(df, ["id"], "seq", ["n"], exclude=("cdc_operation", "seq", "n"), collapse_unchanged=collapse, untracked=("rank",))
    ends = names.select(F.col("seq").alias("__END_AT"), F.col("rank").alias("end_rank"))
    have = have.join(ends, "__END_AT", "left").select("id", "v", "rank", "end_rank")
    assert rows(have) == (simple_collapsed if collapse else simple_history)(events)


def test_null_sequence_comes_first(spark):
    df = log(spark, (1, "a", "c", None, 1), (1, "b", "u", 7, 2))
    assert versions(df) == [(1, "a", None, 7), (1, "b", 7, None)]


def test_plan_has_no_join_and_starts_no_job(spark):
    df = log(spark, *random_log(5))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    plan = scd2(df, ["id"], "seq", ["n"], collapse_unchanged=True)._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Join" not in plan and not tracker.getJobIdsForGroup("planning")


def test_open_versions_are_the_current_rows(spark):
    df = log(spark, *random_log(4))
    assert sorted(r[:2] for r in versions(df) if r[3] is None) == sorted(current(df))

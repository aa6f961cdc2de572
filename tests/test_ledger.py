from datetime import datetime, timedelta, timezone

import pytest
from compare import rows
from pyspark.sql import functions as F

from stratiform.functions.text import asset_kind, change_kind, same_text, user_name
from stratiform.operators import ledger as L
from stratiform.sources import inventory
from stratiform.sources.tables import align_to_schema
from stratiform.specs import SUGGESTIONS

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
T_FORMAT, C_FORMAT = "table description", "column description"
SHORT = (
    "change_id string, catalog string, schema string, asset string, suggestion_format string, suggestion_on string, "
    "suggestion string, suggestion_type string, status string, suggestion_date timestamp, suggestor_id string, "
    "reviewer_id string, review_date timestamp, synced_to_uc boolean"
)


def change(number, status="pending", asset="t", fmt=T_FORMAT, on=None, text="new", kind="modify", day=1,
           user="ann@x.example", reviewer=None, reviewed=None, synced=None):
    return (
        f"c{number}", "c", "s", asset, fmt, on or asset, text, kind, status, NOW + timedelta(days=day), user,
        reviewer, None if reviewed is None else NOW + timedelta(days=reviewed), synced,
    )


def ledger(spark, *changes):
    return align_to_schema(spark.createDataFrame(list(changes), SHORT), SUGGESTIONS.schema)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(
        [
            ("c", "s", "t", "MANAGED", "old"),
            ("c", "s", "v", "VIEW", None),
            ("c", "s", "m", "MATERIALIZED_VIEW", ""),
            ("c", "s", "m2", "MATERIALIZED VIEW", ""),
        ],
        inventory.TABLES,
    )


@pytest.fixture(scope="module")
def columns(spark):
    return spark.createDataFrame(
        [("c", "s", "t", "a", 1, "int", "about a"), ("c", "s", "t", "b", 2, "int", None), ("c", "s", "v", "a", 1, "int", None)],
        inventory.COLUMNS,
    )


REQUEST = (
    "request_id long, catalog string, schema string, asset string, change_type string, column_name string, "
    "old_value string, new_value string, suggestor_id string"
)


def requests(spark, *items):
    return spark.createDataFrame([(i, "c", "s", *item, "ann") for i, item in enumerate(items)], REQUEST)


def test_text_expressions(spark):
    df = spark.createDataFrame([(None, "x"), (" \t\n", "x"), ("a", " "), ("a", None), ("a", "b")], "a string, b string")
    kinds = [r[0] for r in df.select(change_kind(F.col("a"), F.col("b"))).collect()]
    assert kinds == ["add new", "add new", "delete", "delete", "modify"]
    same = spark.createDataFrame([(None, ""), (" a\n", "a"), ("a", "A")], "a string, b string")
    assert [r[0] for r in same.select(same_text(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    types = spark.createDataFrame([("MANAGED",), ("VIEW",), ("MATERIALIZED_VIEW",), ("MATERIALIZED VIEW",), (None,)], "t string")
    assert [r[0] for r in types.select(asset_kind(F.col("t"))).collect()] == [
        "table", "view", "materialized view", "materialized view", "table",
    ]
    users = spark.createDataFrame([("a_b@x",), ("a_b",), (None,)], "u string")
    assert [r[0] for r in users.select(user_name(F.col("u"))).collect()] == ["a_b", "a_b", None]


def test_submit_blocks_pending_and_repeated_targets(spark, tables):
    asked = requests(
        spark,
        ("t", "table_comment", None, "old", "new"),
        ("t", "column_comment", "a", None, "first"),
        ("t", "column_comment", "a", None, "second"),
        ("v", "table_comment", None, None, "x"),
        ("unknown", "table_comment", None, None, "x"),
    )
    prepared = L.prepare_submissions(asked, tables, NOW)
    accepted, rejected = L.submit(ledger(spark, change(1)), prepared)
    assert accepted.columns == SUGGESTIONS.columns
    got = {(r.asset, r.suggestion_on): r for r in accepted.collect()}
    assert set(got) == {("t", "a"), ("v", "v"), ("unknown", "unknown")}
    assert got["t", "a"].suggestion == "first" and got["t", "a"].status == "pending"
    assert (got["v", "v"].asset_type, got["unknown", "unknown"].asset_type) == ("view", "table")
    assert got["t", "a"].reviewer_id is None and got["t", "a"].synced_to_uc is None
    assert [(r.request_id, r.target, r.reason) for r in rejected.orderBy("request_id").collect()] == [
        (0, "table description", L.BLOCKED),
        (2, "column `a`", L.BLOCKED),
    ]
    again = L.submit(ledger(spark, change(1)), L.prepare_submissions(asked, tables, NOW))[0]
    assert rows(again.select("change_id")) == rows(accepted.select("change_id"))
    assert accepted.select("change_id").distinct().count() == 3


def test_decided_target_is_free_again(spark, tables):
    asked = requests(spark, ("t", "table_comment", None, "old", "new"))
    accepted, rejected = L.submit(ledger(spark, change(1, "rejected")), L.prepare_submissions(asked, tables, NOW))
    assert accepted.count() == 1 and rejected.count() == 0


def test_detect_changes(spark):
    target = "catalog string, schema string, asset string, suggestion_format string, suggestion_on string"
    shown = spark.createDataFrame([("c", "s", "t", T_FORMAT, "t", "x"), ("c", "s", "t", C_FORMAT, "a", None)], target + ", old_value string")
    edited = spark.createDataFrame([("c", "s", "t", T_FORMAT, "t", "x"), ("c", "s", "t", C_FORMAT, "a", "y")], target + ", new_value string")
    assert [r.suggestion_on for r in L.detect_changes(shown, edited).collect()] == ["a"]


def test_review(spark):
    df = ledger(spark, change(1), change(2, "rejected", on="x", reviewer="old", reviewed=1), change(3, on="y"))
    ids = spark.createDataFrame([("c1",), ("c2",), ("c9",)], "change_id string")
    decisions = L.decide(ids, "approved", "rob", NOW, "ok")
    state = {r.change_id: (r.status, r.reviewer_id) for r in L.review(df, decisions).collect()}
    assert state == {"c1": ("approved", "rob"), "c2": ("approved", "rob"), "c3": ("pending", None)}
    state = {r.change_id: r.status for r in L.review(df, decisions, only_pending=True).collect()}
    assert state == {"c1": "approved", "c2": "rejected", "c3": "pending"}
    later = decisions.unionByName(L.decide(ids, "rejected", "sue", NOW + timedelta(days=1)))
    assert {r.status for r in L.review(df, later).filter("change_id <> 'c3'").collect()} == {"rejected"}
    with pytest.raises(ValueError):
        L.decide(ids, "done", "rob", NOW)


def test_best_suggestion(spark):
    df = ledger(
        spark,
        change(1, "rejected", day=9),
        change(2, "approved", day=1, text=None),
        change(3, "approved", day=2, text=None),
        change(4, "escalated", day=20),
        change(5, "escalated", on="x"),
        change(6, None, on="y"),
    )
    best = {r.suggestion_on: (r.status, r.suggestion_date, r.suggestion) for r in L.best_suggestions(df).collect()}
    assert best["t"][0] == "approved" and best["t"][1].day == 3 and best["t"][2] == ""
    assert best["x"][0] == "escalated" and best["y"][0] is None


def test_overlay(spark, tables, columns):
    df = ledger(
        spark,
        change(1, "approved", text="waiting"),
        change(2, "approved", "t", C_FORMAT, "a", " about a "),
        change(3, "pending", "t", C_FORMAT, "b", "soon"),
        change(4, "approved", "v", text="done", synced=True),
        change(5, "rejected", "m", text="no"),
        change(6, "pending", "m"),
    )
    shown = {(r.asset, r.name): (r.comment, r.status) for r in L.overlay(tables, columns, df).collect()}
    assert shown == {
        ("t", "t"): ("waiting", "approved"),
        ("t", "a"): ("about a", None),
        ("t", "b"): ("", "pending"),
        ("v", "v"): ("", None),
        ("v", "a"): ("", None),
        ("m", "m"): ("", "pending"),
        ("m2", "m2"): ("", None),
    }


def test_sync_plan(spark, tables):
    df = ledger(
        spark,
        change(1, "approved", text="it's", reviewed=0),
        change(11, "approved", "u", text="it's"),
        change(2, "approved", "v", text="x"),
        change(3, "approved", "m", text="x"),
        change(4, "approved", "m2", C_FORMAT, "a", "x"),
        change(5, "approved", "t", C_FORMAT, "a", "x", kind="delete"),
        change(6, "approved", "gone", text="x"),
        change(7, "approved", "t", "other", text="x"),
        change(8, "approved", "t", text="x", synced=True, reviewed=1),
        change(9, "approved", "t", C_FORMAT, "b`c", None, synced=False),
        change(10),
    )
    assert dict(rows(L.sync_plan(df, tables))) == {
        "c2": "COMMENT ON VIEW `c`.`s`.`v` IS 'x'",
        "c3": "COMMENT ON MATERIALIZED VIEW `c`.`s`.`m` IS 'x'",
        "c4": "COMMENT ON COLUMN `c`.`s`.`m2`.`a` IS 'x'",
        "c5": "ALTER TABLE `c`.`s`.`t` ALTER COLUMN `a` COMMENT ''",
        "c6": "COMMENT ON TABLE `c`.`s`.`gone` IS 'x'",
        "c9": "ALTER TABLE `c`.`s`.`t` ALTER COLUMN `b``c` COMMENT ''",
        "c11": "COMMENT ON TABLE `c`.`s`.`u` IS 'it''s'",
    }


NAMES = ("Orders-7", "a`b", "`", "select", "x.y", "it's", "back\\slash", "é 日")
TEXTS = ("plain", "it's", "ends in \\", "'", "\\'", "two\nlines", "'; DROP TABLE t; --", "", "\\n", "é 日 %s")


def test_every_statement_of_the_plan_parses(spark, tables):
    """Spark's own parser reads the names and the text back as they were."""
    wanted = [(i, n, t) for i, (n, t) in enumerate((n, t) for n in NAMES for t in TEXTS)]
    events = [change(i, "approved", f"{n}{i}", C_FORMAT if i % 2 else T_FORMAT, n, t) for i, n, t in wanted]
    plan = dict(rows(L.sync_plan(ledger(spark, *events), tables)))
    assert len(plan) == len(wanted)
    parser = spark._jsparkSession.sessionState().sqlParser()
    for i, n, t in wanted:
        statement = plan[f"c{i}"]
        parser.parsePlan(statement)
        name, text = statement.split(" COMMENT " if i % 2 else " IS ", 1)
        assert spark.sql(f"SELECT {text} AS t").first().t == t
        if i % 2 == 0:
            assert list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(parser.parseMultipartIdentifier(name.removeprefix("COMMENT ON TABLE ")))) == ["c", "s", f"{n}{i}"]


def test_the_last_review_of_a_target_is_planned(spark, tables):
    def planned(*events):
        return [r.change_id for r in L.sync_plan(ledger(spark, *events), tables).collect()]

    first, second = change(1, "approved", text="a", reviewed=1), change(2, "approved", text="b", reviewed=2)
    assert planned(first, second) == planned(second, first) == ["c2"]
    assert planned(first, change(2, "approved", text="b", reviewed=2, synced=True)) == []
    assert planned(change(1, "approved", text="a", reviewed=1, synced=True), second) == ["c2"]
    assert planned(first, change(2, "rejected", text="b", reviewed=2)) == ["c1"]


def test_apply_and_mark(spark, tables, columns):
    df = ledger(
        spark,
        change(1, "approved", text="first", reviewed=1),
        change(2, "approved", text="last", reviewed=2),
        change(3, "approved", "t", C_FORMAT, "a", "x", kind="delete", reviewed=1),
        change(4, "approved", "v", text="skipped", synced=True, reviewed=1),
        change(5, "pending", "m", text="skipped"),
    )
    new_tables, new_columns = L.apply_approved(tables, columns, df)
    assert {r.table_name: r.comment for r in new_tables.collect()} == {"t": "last", "v": None, "m": "", "m2": ""}
    assert {(r.table_name, r.column_name): r.comment for r in new_columns.collect()} == {
        ("t", "a"): "", ("t", "b"): None, ("v", "a"): None,
    }
    done = spark.createDataFrame([("c1",), ("c1",), ("c5",)], "change_id string")
    marked = {r.change_id: r.synced_to_uc for r in L.mark_synced(df, done).collect()}
    assert marked == {"c1": True, "c2": None, "c3": None, "c4": True, "c5": None}


def test_current_values(spark, tables, columns):
    targets = spark.createDataFrame(
        [("c", "s", "t", T_FORMAT, "t"), ("c", "s", "t", C_FORMAT, "b"), ("c", "s", "zz", T_FORMAT, "zz")],
        "catalog string, schema string, asset string, suggestion_format string, suggestion_on string",
    )
    assert [(r.asset, r.suggestion_on, r.current_value) for r in L.current_values(targets, tables, columns).orderBy("asset", "suggestion_on").collect()] == [
        ("t", "b", ""), ("t", "t", "old"), ("zz", "zz", ""),
    ]


def test_retention(spark):
    df = ledger(
        spark,
        change(1, "approved", reviewed=0, synced=True),
        change(2, "approved", reviewed=0),
        change(3, "rejected", reviewed=0),
        change(4, "rejected", reviewed=20),
        change(5, "rejected"),
        change(6),
    )
    left = L.retained(df, NOW + timedelta(days=31))
    assert [r.change_id for r in left.orderBy("change_id").collect()] == ["c2", "c4", "c5", "c6"]


def test_queue_and_asset_order(spark):
    df = ledger(
        spark,
        change(1, asset="a", day=5),
        change(2, asset="a", fmt=C_FORMAT, on="z", day=1),
        change(3, asset="a", fmt=C_FORMAT, on="b", day=9),
        change(4, asset="b", day=3),
        change(5, "approved", asset="c"),
    )
    assert [(r.asset, r.change_count, r.first_submitted.day) for r in L.pending_queue(df).collect()] == [
        ("b", 1, 4), ("a", 2 + 1, 2),
    ]
    assets = spark.createDataFrame([("c", "s", "a")], "catalog string, schema string, asset string")
    assert [r.change_id for r in L.pending_changes(df, assets).collect()] == ["c1", "c3", "c2"]


def test_user_reports(spark):
    df = ledger(
        spark,
        change(1, user="a_b@x.example", day=1),
        change(2, "approved", user="a_b", day=3, reviewer="rob", reviewed=4),
        change(3, "rejected", user="a_b@y.example", day=2, reviewer="rob@x.example", reviewed=9),
        change(4, user="axb@x.example"),
    )
    assert [r.change_id for r in L.submitter_history(df, "a_b@any.example").collect()] == ["c2", "c3", "c1"]
    assert [r.change_id for r in L.submitter_history(df, "a_b", "approved").collect()] == ["c2"]
    assert L.submitter_history(df, "a_b", "all").count() == 3
    assert L.submitter_kpis(df, "a_b").first().asDict() == {
        "total_suggestions": 3, "pending_count": 1, "approved_count": 1, "rejected_count": 1,
    }
    assert L.submitter_kpis(df, "nobody").first().total_suggestions == 0
    assert {r.user_id: r.total_suggestions for r in L.submitter_kpis(df).collect()} == {"a_b": 3, "axb": 1}
    assert [r.change_id for r in L.reviewer_history(df, "rob").collect()] == ["c3", "c2"]
    assert L.reviewer_kpis(df, "rob").first().asDict() == {"total_reviews": 2, "approved_count": 1, "rejected_count": 1}
    people = spark.createDataFrame([("axb",), ("rob",)], "user_id string")
    assert [r.change_id for r in L.submitter_history(df, people).collect()] == ["c4"]


def test_reports(spark):
    df = ledger(spark, change(1, "approved"), change(2, "approved", synced=False), change(3, "approved", synced=True), change(4))
    assert L.not_synced(df).count() == 2
    L.register_not_synced(df, "waiting")
    assert spark.table("waiting").count() == 2
    assert L.pending_rows(df).count() == 1
    assert L.review_history(df).count() == 4

"""Description-change ledger: submit, review, overlay, sync, retention and reports.

Every operator works on whole DataFrames of requests, decisions or targets. A target is one table or
column description: (catalog, schema, asset, suggestion_format, suggestion_on). One target may hold
many rows, so "one row per target" is always an aggregate or a limited rank that shrinks the rows of a
target in each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions.text import (
    COLUMN_FORMAT,
    DELETE,
    TABLE_FORMAT,
    asset_kind,
    change_kind,
    has_text,
    is_synced,
    sql_name,
    sql_text,
    user_name,
)
from stratiform.sources.tables import align_to_schema, delete_where, update_by_key
from stratiform.specs import SUGGESTIONS

ASSET = ["catalog", "schema", "asset"]
TARGET = [*ASSET, "suggestion_format", "suggestion_on"]

# Review states and the reason of a blocked submission.
PENDING, APPROVED, REJECTED = "pending", "approved", "rejected"
BLOCKED = "already has a pending change awaiting review"

# Request kinds and their ledger names.
FORMATS = {"table_comment": TABLE_FORMAT, "column_comment": COLUMN_FORMAT}


def _status(value: str) -> Column:
    return F.col("status") == value


def _as_assets(inventory: DataFrame, *columns: str) -> DataFrame:
    """Inventory rows under the ledger's names for an asset."""
    return inventory.select(
        F.col("table_catalog").alias("catalog"),
        F.col("table_schema").alias("schema"),
        F.col("table_name").alias("asset"),
        *columns,
    )


def _inventory_targets(inv_tables: DataFrame, inv_columns: DataFrame) -> DataFrame:
    """Every describable target with its current text."""
    tables = _as_assets(inv_tables, "table_type", "comment").select(
        *ASSET,
        F.lit(TABLE_FORMAT).alias("suggestion_format"),
        F.col("asset").alias("suggestion_on"),
        F.col("table_type").alias("type"),
        "comment",
    )
    columns = _as_assets(inv_columns, "column_name", "data_type", "comment").select(
        *ASSET,
        F.lit(COLUMN_FORMAT).alias("suggestion_format"),
        F.col("column_name").alias("suggestion_on"),
        F.col("data_type").alias("type"),
        "comment",
    )
    return tables.unionByName(columns)


def current_values(targets: DataFrame, inv_tables: DataFrame, inv_columns: DataFrame) -> DataFrame:
    """Current text of each target, empty when there is none or the target is unknown."""
    known = _inventory_targets(inv_tables, inv_columns).select(*TARGET, F.col("comment").alias("_text"))
    return targets.join(known, TARGET, "left").select(
        *targets.columns, F.coalesce("_text", F.lit("")).alias("current_value")
    )


def detect_changes(shown: DataFrame, edited: DataFrame) -> DataFrame:
    """Targets whose edited text differs from the shown text.

    `shown` has TARGET and `old_value`, `edited` has TARGET and `new_value`, one row per target.
    """
    return shown.join(edited, TARGET).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def prepare_submissions(requests: DataFrame, inv_tables: DataFrame, submitted_at: datetime) -> DataFrame:
    """Ledger rows for requests, plus `request_id` and `target` for the report.

    A request has `request_id` (unique, its order is the order of submission), the asset, `change_type`,
    `column_name`, `old_value`, `new_value` and `suggestor_id`. The change id is a hash of the content,
    so a repeated run gives the same ids.
    """
    request_format = F.col("change_type")
    for kind, name in FORMATS.items():
        request_format = F.when(F.col("change_type") == kind, F.lit(name)).otherwise(request_format)
    named = has_text(F.col("column_name"))
    kinds = _as_assets(inv_tables, "table_type").groupBy(*ASSET).agg(F.min("table_type").alias("table_type"))
    stamp = F.lit(submitted_at).cast("timestamp")
    rows = requests.join(kinds, ASSET, "left").select(
        "request_id",
        F.when(named, F.concat(F.lit("column `"), "column_name", F.lit("`")))
        .otherwise(TABLE_FORMAT)
        .alias("target"),
        stamp.alias("suggestion_date"),
        "suggestor_id",
        *ASSET,
        asset_kind(F.col("table_type")).alias("asset_type"),
        request_format.alias("suggestion_format"),
        F.when(named, F.col("column_name")).otherwise(F.col("asset")).alias("suggestion_on"),
        F.col("new_value").alias("suggestion"),
        change_kind(F.col("old_value"), F.col("new_value")).alias("suggestion_type"),
        F.lit(PENDING).alias("status"),
    )
    identity = F.to_json(
        F.struct(*TARGET, "suggestor_id", F.lit(submitted_at.isoformat()).alias("at"), "request_id")
    )
    return rows.withColumn("change_id", F.sha2(identity, 256))


def pending_targets(ledger: DataFrame) -> DataFrame:
    return ledger.filter(_status(PENDING)).select(*TARGET).distinct()


def submit(ledger: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted ledger rows, and rejected requests with their reason.

    A target that is pending in the ledger is blocked. Within the batch the first request for a target
    is accepted and the later ones are blocked by it. The rejected side joins by request id, which is
    unique, so a much requested target does not make a hot join key.
    """
    first = (
        prepared.groupBy(*TARGET)
        .agg(F.min_by(F.struct(*[c for c in prepared.columns if c not in TARGET]), "request_id").alias("_row"))
        .select(*TARGET, "_row.*")
    )
    accepted = first.join(pending_targets(ledger), TARGET, "left_anti")
    rejected = prepared.join(accepted.select("request_id"), "request_id", "left_anti").select(
        "request_id", *TARGET, "target", F.lit(BLOCKED).alias("reason")
    )
    return align_to_schema(accepted, SUGGESTIONS.schema), rejected


def review(ledger: DataFrame, decisions: DataFrame, only_pending: bool = False) -> DataFrame:
    """The ledger after decisions `change_id, status, reviewer_id, review_date, reviewer_comments`.

    The latest decision on a change counts. A decided row may be decided again unless `only_pending`.
    """
    columns = ["status", "reviewer_id", "review_date", "reviewer_comments"]
    last = (
        decisions.groupBy("change_id")
        .agg(F.max_by(F.struct(*columns), F.struct("review_date", "status", "reviewer_id")).alias("_row"))
        .select("change_id", "_row.*")
    )
    return update_by_key(ledger, last, "change_id", columns, _status(PENDING) if only_pending else None)


def decide(change_ids: DataFrame, status: str, reviewer: str, at: datetime, comments: str = "") -> DataFrame:
    """One decision for a set of ids."""
    if status not in (APPROVED, REJECTED):
        raise ValueError("a decision is approved or rejected")
    return change_ids.select(
        "change_id",
        F.lit(status).alias("status"),
        F.lit(reviewer).alias("reviewer_id"),
        F.lit(at).cast("timestamp").alias("review_date"),
        F.lit(comments).alias("reviewer_comments"),
    )


def best_suggestions(ledger: DataFrame) -> DataFrame:
    """One suggestion per target: pending before approved before rejected, then the newest.

    Spark limits the rank in each task before the shuffle, so a hot target moves few rows.
    """
    priority = (
        F.when(_status(PENDING), 1).when(_status(APPROVED), 2).when(_status(REJECTED), 3).otherwise(4)
    )
    order = Window.partitionBy(*TARGET).orderBy(priority, F.col("suggestion_date").desc(), "change_id")
    return (
        ledger.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .select(
            *TARGET,
            "status",
            F.coalesce("suggestion", F.lit("")).alias("suggestion"),
            "suggestor_id",
            "suggestion_date",
            "suggestion_type",
            F.coalesce("synced_to_uc", F.lit(False)).alias("synced_to_uc"),
        )
    )


def overlay(inv_tables: DataFrame, inv_columns: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every table and column with the text to show and its status.

    An approved suggestion that is not synced shows its own text, a pending one the current text.
    """
    best = best_suggestions(ledger).select(*TARGET, "status", "suggestion", "synced_to_uc")
    current = F.coalesce("comment", F.lit(""))
    waiting = _status(APPROVED) & ~is_synced(F.col("synced_to_uc"), F.col("suggestion"), current)
    joined = _inventory_targets(inv_tables, inv_columns).join(best, TARGET, "left")
    return joined.select(
        *ASSET,
        "suggestion_format",
        F.col("suggestion_on").alias("name"),
        "type",
        F.when(waiting, F.col("suggestion")).otherwise(current).alias("comment"),
        F.when(waiting, APPROVED).when(_status(PENDING), PENDING).alias("status"),
    )


def not_synced(ledger: DataFrame) -> DataFrame:
    """Approved changes still to be written to the catalog."""
    return ledger.filter(_status(APPROVED) & ~F.coalesce("synced_to_uc", F.lit(False)))


def register_not_synced(ledger: DataFrame, name: str = "pending_sync") -> None:
    not_synced(ledger).createOrReplaceTempView(name)


def _last_approved(ledger: DataFrame) -> DataFrame:
    """For each target the approved change reviewed last, if it is still to be written.

    An older approval is overruled by it, whether written or not, so a target never has two texts to write.
    """
    text = F.when(F.col("suggestion_type") == DELETE, "").otherwise(F.coalesce("suggestion", F.lit("")))
    synced = F.coalesce("synced_to_uc", F.lit(False)).alias("synced")
    last = F.max_by(
        F.struct("change_id", text.alias("new_text"), synced), F.struct("review_date", "suggestion_date", "change_id")
    )
    latest = ledger.filter(_status(APPROVED)).groupBy(*TARGET).agg(last.alias("_last"))
    return latest.filter(~F.col("_last.synced")).select(*TARGET, "_last.change_id", "_last.new_text")


def sync_plan(ledger: DataFrame, inv_tables: DataFrame) -> DataFrame:
    """Statement text for each target with an approved change to write: `change_id, statement`.

    Names are quoted part by part and texts as literals, so any name and any text make one statement.
    """
    kinds = _as_assets(inv_tables, "table_type").groupBy(*ASSET).agg(F.min("table_type").alias("table_type"))
    rows = _last_approved(ledger).join(kinds, ASSET, "left")
    kind = F.upper(asset_kind(F.col("table_type")))
    table, column = [F.col(c) for c in ASSET], F.col("suggestion_on")
    name, text = sql_name(*table), sql_text(F.col("new_text"))
    on_table = F.format_string("COMMENT ON %s %s IS %s", kind, name, text)
    on_column = F.when(
        kind == "TABLE",
        F.format_string("ALTER TABLE %s ALTER COLUMN %s COMMENT %s", name, sql_name(column), text),
    ).otherwise(F.format_string("COMMENT ON COLUMN %s IS %s", sql_name(*table, column), text))
    statement = F.when(F.col("suggestion_format") == TABLE_FORMAT, on_table).when(
        F.col("suggestion_format") == COLUMN_FORMAT, on_column
    )
    return rows.select("change_id", statement.alias("statement")).filter(F.col("statement").isNotNull())


def apply_approved(
    inv_tables: DataFrame, inv_columns: DataFrame, ledger: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The inventories with all approved, unsynced texts written in; the last review of a target wins."""
    last = _last_approved(ledger).withColumnRenamed("new_text", "_text")

    def written(inventory: DataFrame, kind: str, key: dict[str, str]) -> DataFrame:
        texts = last.filter(F.col("suggestion_format") == kind).select(
            *[F.col(c).alias(n) for n, c in key.items()], "_text"
        )
        joined = inventory.join(texts, list(key), "left")
        return joined.select(
            *[F.coalesce("_text", "comment").alias(c) if c == "comment" else F.col(c) for c in inventory.columns]
        )

    table_key = {"table_catalog": "catalog", "table_schema": "schema", "table_name": "asset"}
    return (
        written(inv_tables, TABLE_FORMAT, table_key),
        written(inv_columns, COLUMN_FORMAT, {**table_key, "column_name": "suggestion_on"}),
    )


def mark_synced(ledger: DataFrame, succeeded: DataFrame) -> DataFrame:
    """The ledger with the ids that succeeded marked; rows approved or failed since stay open."""
    done = succeeded.select("change_id").distinct().withColumn("synced_to_uc", F.lit(True))
    return update_by_key(ledger, done, "change_id", ["synced_to_uc"], _status(APPROVED))


def retained(ledger: DataFrame, as_of: date | datetime, days: int = 30) -> DataFrame:
    """The ledger without synced approved rows and rejected rows reviewed more than `days` ago."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    finished = (_status(APPROVED) & F.col("synced_to_uc")) | _status(REJECTED)
    return delete_where(ledger, finished & (F.col("review_date") < limit))


def pending_rows(ledger: DataFrame) -> DataFrame:
    return ledger.filter(_status(PENDING)).orderBy(F.col("suggestion_date").desc(), "change_id")


def pending_queue(ledger: DataFrame) -> DataFrame:
    """Assets with pending changes, the newest first submission on top."""
    return (
        ledger.filter(_status(PENDING))
        .groupBy(*ASSET)
        .agg(F.count(F.lit(1)).alias("change_count"), F.min("suggestion_date").alias("first_submitted"))
        .orderBy(F.col("first_submitted").desc(), *ASSET)
    )


def pending_changes(ledger: DataFrame, assets: DataFrame) -> DataFrame:
    """Pending changes of the given assets: table texts first, then columns by name and time."""
    rank = (
        F.when(F.col("suggestion_format") == TABLE_FORMAT, 1)
        .when(F.col("suggestion_format") == COLUMN_FORMAT, 2)
        .otherwise(3)
    )
    rows = ledger.filter(_status(PENDING)).join(assets.select(*ASSET).distinct(), ASSET, "left_semi")
    return rows.select(
        "change_id",
        "suggestion_format",
        "suggestion_on",
        "suggestion",
        "suggestion_type",
        "suggestor_id",
        "suggestion_date",
        "asset_type",
        *ASSET,
    ).orderBy(*ASSET, rank, "suggestion_on", "suggestion_date", "change_id")


def _of_users(ledger: DataFrame, column: str, users: DataFrame | str | None, status: str | None) -> DataFrame:
    """Rows of one user, of a DataFrame of `user_id`, or of everyone; users match by normalised name."""
    rows = ledger.filter(F.col(column).isNotNull())
    if status and status != "all":
        rows = rows.filter(_status(status))
    if isinstance(users, str):
        return rows.filter(user_name(F.col(column)) == users.split("@")[0])
    if users is not None:
        names = users.select(user_name(F.col("user_id")).alias("_user")).distinct()
        return rows.join(names, user_name(F.col(column)) == F.col("_user"), "left_semi")
    return rows


_DETAILS = ["asset_type", "suggestion_format", "suggestion_on", "suggestion", "suggestion_type", "status"]
_REVIEW = ["reviewer_id", "review_date", "reviewer_comments", "change_id"]


def submitter_history(
    ledger: DataFrame, users: DataFrame | str | None = None, status: str | None = None, submitter: bool = False
) -> DataFrame:
    """Suggestions of submitters, newest first. `submitter=True` also shows whose they are."""
    extra = ["suggestor_id"] if submitter else []
    return (
        _of_users(ledger, "suggestor_id", users, status)
        .select("suggestion_date", *extra, *ASSET, *_DETAILS, *_REVIEW)
        .orderBy(F.col("suggestion_date").desc(), F.col("review_date").desc(), "change_id")
    )


def reviewer_history(
    ledger: DataFrame, users: DataFrame | str | None = None, status: str | None = None
) -> DataFrame:
    """Reviews of reviewers, newest first."""
    return (
        _of_users(ledger, "reviewer_id", users, status)
        .select("suggestion_date", "suggestor_id", *ASSET, *_DETAILS, *_REVIEW)
        .orderBy(F.col("review_date").desc(), F.col("suggestion_date").desc(), "change_id")
    )


def _user_counts(
    ledger: DataFrame, column: str, users: DataFrame | str | None, status: str | None, counts: Sequence[Column]
) -> DataFrame:
    rows = _of_users(ledger, column, users, status)
    if isinstance(users, str):
        return rows.agg(*counts)
    return rows.groupBy(user_name(F.col(column)).alias("user_id")).agg(*counts)


def submitter_kpis(
    ledger: DataFrame, users: DataFrame | str | None = None, status: str | None = None
) -> DataFrame:
    """Counts by status: one row for one user, else a row per normalised user."""
    return _user_counts(
        ledger,
        "suggestor_id",
        users,
        status,
        [
            F.count(F.lit(1)).alias("total_suggestions"),
            F.count_if(_status(PENDING)).alias("pending_count"),
            F.count_if(_status(APPROVED)).alias("approved_count"),
            F.count_if(_status(REJECTED)).alias("rejected_count"),
        ],
    )


def reviewer_kpis(
    ledger: DataFrame, users: DataFrame | str | None = None, status: str | None = None
) -> DataFrame:
    return _user_counts(
        ledger,
        "reviewer_id",
        users,
        status,
        [
            F.count(F.lit(1)).alias("total_reviews"),
            F.count_if(_status(APPROVED)).alias("approved_count"),
            F.count_if(_status(REJECTED)).alias("rejected_count"),
        ],
    )


def review_history(ledger: DataFrame) -> DataFrame:
    """Number of changes by submitter, reviewer, status and sync flag."""
    return ledger.groupBy("suggestor_id", "reviewer_id", "status", "synced_to_uc").agg(
        F.count(F.lit(1)).alias("change_count")
    )

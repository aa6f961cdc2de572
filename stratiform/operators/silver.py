"""Validated layer: articles and transactions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stratiform.functions.measures import margin, margin_pct, tried
from stratiform.functions.text import title_cased, trimmed, upper_cased
from stratiform.operators.bronze import SILVER_SOURCE, with_audit
from stratiform.operators.quality import Rule, quality_flag, refine

# Statuses of an article. They are compared without case, on the normalised column.
ARTICLE_STATUSES = ("Active", "Blocked", "Pending", "Discontinued")
_STATUS_LIST = ", ".join(f"'{s.upper()}'" for s in ARTICLE_STATUSES)

ARTICLE_RULES = (
    Rule("valid_article_id", "article_id IS NOT NULL", "fail"),
    Rule("valid_prices", "base_cost >= 0 AND list_price >= 0"),
    Rule("valid_status", f"status IN ({_STATUS_LIST})"),
)
TRANSACTION_RULES = (
    Rule("valid_transaction_id", "transaction_id IS NOT NULL", "fail"),
    Rule("valid_article_id", "article_id IS NOT NULL", "fail"),
    Rule("valid_quantity", "quantity > 0"),
    Rule("valid_amounts", "unit_price >= 0 AND total_amount >= 0"),
)


def article_columns() -> list[Column]:
    cost, price = F.col("base_cost").try_cast("double"), F.col("list_price").try_cast("double")
    return [
        trimmed("article_id"),
        title_cased("department"),
        title_cased("category"),
        title_cased("subcategory"),
        upper_cased("status"),
        cost.alias("base_cost"),
        price.alias("list_price"),
        margin(price, cost).alias("profit_margin"),
        margin_pct(price, cost).alias("margin_percentage"),
        quality_flag(
            [
                ("MISSING_COST", F.col("base_cost").isNull()),
                ("NEGATIVE_MARGIN", price < cost),
                ("MISSING_STATUS", F.col("status").isNull()),
            ]
        ),
    ]


def transaction_columns() -> list[Column]:
    return [
        trimmed("transaction_id"),
        trimmed("article_id"),
        tried("quantity", "int"),
        tried("unit_price", "double"),
        tried("total_amount", "double"),
        quality_flag(
            [
                ("MISSING_QUANTITY", F.col("quantity").isNull()),
                ("NEGATIVE_PRICE", F.col("unit_price").try_cast("double") < 0),
            ]
        ),
    ]


def silver_articles(bronze: DataFrame, audit_ts: datetime, observation: Observation | None = None) -> DataFrame:
    """Articles trimmed, typed and checked, with margins and a quality flag. Batch or stream."""
    rows = refine(bronze, article_columns(), ARTICLE_RULES, observation)
    return with_audit(rows, audit_ts, SILVER_SOURCE)


def silver_transactions(bronze: DataFrame, audit_ts: datetime, observation: Observation | None = None) -> DataFrame:
    """Transactions trimmed, typed and checked, with a quality flag. Batch or stream."""
    rows = refine(bronze, transaction_columns(), TRANSACTION_RULES, observation)
    return with_audit(rows, audit_ts, SILVER_SOURCE)

"""Standard conformance of an inventory: one row per table and rule.

Inputs are inventories, not SQL text. `inv_tables` may carry `properties` (map) and `rule_count`
(declared quality rules); `observed_sources` lists the `source_system` values found in each table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.functions.text import has_text
from stratiform.operators.bronze import SOURCE_SYSTEMS
from stratiform.sources.inventory import TABLE_KEY
from stratiform.specs import AUDIT_COLUMNS

# Layer properties of the standard.
CHANGE_FEED = "delta.enableChangeDataFeed"
ROW_TRACKING = "delta.enableRowTracking"
REQUIRED_PROPERTIES = {
    "bronze": ("quality", CHANGE_FEED),
    "silver": ("quality", CHANGE_FEED, ROW_TRACKING),
    "gold": ("quality", CHANGE_FEED),
}
KINDS = ("STREAMING TABLE", "MATERIALIZED VIEW")
NAME_PATTERN = "^(bronze|silver|gold)(_[a-z0-9]+)+$"
FLAG = "data_quality_flag"


def layer_of(name: Column) -> Column:
    """Layer prefix of a table name, empty when there is none."""
    return F.regexp_extract(name, "^(bronze|silver|gold)_", 1)


def column_facts(inv_columns: DataFrame) -> DataFrame:
    """Last column of each table, last column besides `source_system`, presence of the flag column.

    Plain aggregates: the columns of a table are combined in each task before the shuffle.
    """
    name, ordinal = F.col("column_name"), F.col("ordinal")
    return inv_columns.groupBy(*TABLE_KEY).agg(
        F.max_by(name, ordinal).alias("_last"),
        F.max_by(name, F.when(name != AUDIT_COLUMNS[1], ordinal)).alias("_last_other"),
        F.bool_or(name == FLAG).alias("_has_flag"),
    )


def _unpivoted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    lines = [
        F.struct(F.lit(name).alias("rule"), F.coalesce(passed, F.lit(False)).alias("passed"))
        for name, passed in rules.items()
    ]
    return df.select(*TABLE_KEY, F.inline(F.array(*lines)))


def _table_rules() -> dict[str, Column]:
    return {
        "name": F.rlike("table_name", F.lit(NAME_PATTERN)),
        "audit_columns_last": (F.col("_last_other") == AUDIT_COLUMNS[0]) & (F.col("_last") == AUDIT_COLUMNS[1]),
        "comment": has_text(F.col("comment")),
    }


def _layer_rules() -> dict[str, Column]:
    layer = layer_of(F.col("table_name"))
    properties = F.lit(False)
    for name, keys in REQUIRED_PROPERTIES.items():
        fits = (layer == name) & (F.col("properties")["quality"] == name)
        for key in keys[1:]:
            fits = fits & (F.col("properties")[key] == "true")
        properties = properties | F.coalesce(fits, F.lit(False))
    silver = layer == "silver"
    return {
        "properties": properties,
        "kind": F.upper(F.replace("table_type", F.lit("_"), F.lit(" "))).isin(*KINDS),
        "quality_flag": ~silver | F.coalesce("_has_flag", F.lit(False)),
        "rules_in_silver_only": silver | (F.coalesce("rule_count", F.lit(0)) == 0),
    }


def table_conformance(inv_tables: DataFrame, inv_columns: DataFrame) -> DataFrame:
    """Name form, audit columns last, description present."""
    return _unpivoted(inv_tables.join(column_facts(inv_columns), TABLE_KEY, "left"), _table_rules())


def layer_conformance(inv_tables: DataFrame, inv_columns: DataFrame) -> DataFrame:
    """Layer properties, kind of table, flag column in silver, rules only in silver."""
    return _unpivoted(inv_tables.join(column_facts(inv_columns), TABLE_KEY, "left"), _layer_rules())


def source_conformance(observed_sources: DataFrame) -> DataFrame:
    """Whether every `source_system` value of a table is allowed in its layer."""
    layer = layer_of(F.col("table_name"))
    allowed = F.lit(False)
    for name, values in SOURCE_SYSTEMS.items():
        allowed = allowed | ((layer == name) & F.col("source_system").isin(*values))
    return (
        observed_sources.groupBy(*TABLE_KEY)
        .agg(F.bool_and(F.coalesce(allowed, F.lit(False))).alias("passed"))
        .select(*TABLE_KEY, F.lit("source_system").alias("rule"), "passed")
    )


def conformance(inv_tables: DataFrame, inv_columns: DataFrame, observed_sources: DataFrame) -> DataFrame:
    """All rules of the standard as `table key, rule, passed`; the inventories are joined once."""
    joined = inv_tables.join(column_facts(inv_columns), TABLE_KEY, "left")
    return _unpivoted(joined, {**_table_rules(), **_layer_rules()}).unionByName(
        source_conformance(observed_sources)
    )

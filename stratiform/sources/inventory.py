"""Catalog inventory: tables and columns as DataFrames, listings, allow-lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "table_catalog string, table_schema string, table_name string, table_type string, comment string"
COLUMNS = (
    "table_catalog string, table_schema string, table_name string, column_name string, "
    "ordinal int, data_type string, comment string"
)
TABLE_KEY = ["table_catalog", "table_schema", "table_name"]

# Schemas of the platform itself.
INTERNAL_SCHEMAS = ("information_schema", "system")


def catalog_tables(spark: SparkSession, databases: Sequence[str] | None = None) -> DataFrame:
    """Inventory of the session catalog's tables; the catalog API lists names on the driver."""
    names = databases or [d.name for d in spark.catalog.listDatabases()]
    rows = [
        (t.catalog, t.namespace[0] if t.namespace else None, t.name, t.tableType, t.description)
        for d in names
        for t in spark.catalog.listTables(d)
        if not t.isTemporary
    ]
    return spark.createDataFrame(rows, TABLES)


def catalog_columns(spark: SparkSession, databases: Sequence[str] | None = None) -> DataFrame:
    names = databases or [d.name for d in spark.catalog.listDatabases()]
    rows = [
        (t.catalog, d, t.name, c.name, i, c.dataType, c.description)
        for d in names
        for t in spark.catalog.listTables(d)
        if not t.isTemporary
        for i, c in enumerate(spark.catalog.listColumns(f"{d}.{t.name}"), 1)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def is_user_schema(schema: Column) -> Column:
    """False for platform schemas and for names that start with two underscores."""
    return ~F.startswith(schema, F.lit("__")) & ~schema.isin(*INTERNAL_SCHEMAS)


def parse_allow_list(text: str) -> dict[str, list[str]]:
    """`cat:s1,s2;cat2:s3` as catalog -> schemas; a catalog without schemas allows all of them."""
    allowed: dict[str, list[str]] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        catalog, _, schemas = part.partition(":")
        allowed[catalog.strip()] = [s.strip() for s in schemas.split(",") if s.strip()]
    return allowed


def in_allow_list(
    inventory: DataFrame, allowed: Mapping[str, Sequence[str]], catalog: str = "table_catalog", schema: str = "table_schema"
) -> DataFrame:
    """Rows of the allowed catalogs, and of the allowed schemas where a catalog names them."""
    keep = F.lit(False)
    for name, schemas in allowed.items():
        inside = F.col(catalog) == name
        keep = keep | (inside & F.col(schema).isin(*schemas) if schemas else inside)
    return inventory.filter(keep)


def list_schemas(inv_tables: DataFrame, catalog: str, allowed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Sorted schema names of a catalog; an allow-list for the catalog replaces the platform filter."""
    rows = inv_tables.filter(F.col("table_catalog") == catalog)
    schema = F.col("table_schema")
    listed = (allowed or {}).get(catalog)
    rows = rows.filter(schema.isin(*listed) if listed else is_user_schema(schema))
    return rows.select(schema.alias("schema_name")).distinct().orderBy("schema_name")


def list_tables(inv_tables: DataFrame, catalog: str, schema: str) -> DataFrame:
    """Sorted tables and views of a schema."""
    here = (F.col("table_catalog") == catalog) & (F.col("table_schema") == schema)
    return inv_tables.filter(here).select("table_name", "table_type").orderBy("table_name")

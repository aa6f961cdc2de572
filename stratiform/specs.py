"""Declared tables: one spec gives the read schema, the DDL, the keys and the column roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

AUDIT_COLUMNS = ("audit_ts", "source_system")

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
}


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    referenced: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    comment: str
    schema: T.StructType
    keys: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()
    date_format: str = "yyyy-MM-dd"
    properties: tuple[tuple[str, str], ...] = ()

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def ddl(self, table: str, location: str | None = None) -> str:
        """CREATE TABLE text. Partition columns go last, as Spark stores them."""
        ordered = [f for f in self.schema.fields if f.name not in self.partition_by]
        ordered += [self.schema[c] for c in self.partition_by]
        lines = []
        for field in ordered:
            line = f"  `{field.name}` {field.dataType.simpleString().upper()}"
            if not field.nullable:
                line += " NOT NULL"
            note = field.metadata.get("comment")
            if note:
                line += f" COMMENT {_quote(note)}"
            lines.append(line)
        text = f"CREATE TABLE IF NOT EXISTS {table} (\n" + ",\n".join(lines) + "\n) USING parquet"
        if self.partition_by:
            text += "\nPARTITIONED BY (" + ", ".join(f"`{c}`" for c in self.partition_by) + ")"
        if location:
            text += f"\nLOCATION {_quote(location)}"
        text += f"\nCOMMENT {_quote(self.comment)}"
        if self.properties:
            pairs = ", ".join(f"{_quote(k)} = {_quote(v)}" for k, v in self.properties)
            text += f"\nTBLPROPERTIES ({pairs})"
        return text


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def schema_of(text: str) -> T.StructType:
    """Schema from lines `name type[!] [comment]`; `!` marks a required column."""
    fields = []
    for line in text.strip().splitlines():
        name, kind, *note = line.split(None, 2)
        meta = {"comment": note[0].strip()} if note else {}
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!"), meta))
    return T.StructType(fields)


TRANSACTIONS = TableSpec(
    name="transactions",
    comment="Sales lines at transaction grain",
    keys=("transaction_id",),
    foreign_keys=(ForeignKey("article_id", "retail_articles", "article_id"),),
    partition_by=("transaction_date",),
    cluster_by=("article_id",),
    date_format="dd-MM-yyyy",
    schema=schema_of("""
        transaction_id string! Identifier of the sales line
        basket_id string! Basket the line belongs to
        article_id string! Article sold
        transaction_date date! Day of sale
        quantity bigint! Units sold
        unit_price double! Price of one unit
        discount_pct bigint! Discount in percent
        total_amount double! Amount charged after discounts
        store_id string! Store identifier
        store_name string! Store name
        region string! Sales region
        store_type string! Kind of store
        sales_channel string! Channel of the sale
        customer_id string Customer, when known
    """),
)

TRANSACTIONS_KEYED = TableSpec(
    name="transactions",
    comment="Sales lines at transaction grain, partitioned by calendar key",
    keys=("transaction_id",),
    foreign_keys=(
        ForeignKey("article_id", "retail_articles", "article_id"),
        ForeignKey("date_key", "date_dimensions", "date_key"),
    ),
    partition_by=("date_key",),
    cluster_by=("article_id",),
    date_format="dd-MM-yyyy",
    schema=T.StructType(
        TRANSACTIONS.schema.fields[:4]
        + schema_of("date_key bigint Calendar key as YYYYMMDD").fields
        + TRANSACTIONS.schema.fields[4:]
    ),
)

RETAIL_ARTICLES = TableSpec(
    name="retail_articles",
    comment="Articles on sale, with cost, price and supply data",
    keys=("article_id",),
    cluster_by=("department", "article_id"),
    schema=schema_of("""
        article_id string! Article identifier
        status string! Life cycle status
        valid_from date! First day of validity
        valid_to date Last day of validity
        lifecycle_group string! Life cycle group
        department string! Department
        category string! Category in the department
        subcategory string! Subcategory in the category
        brand string! Brand
        article_name string! Display name
        short_description string Short text
        supplier_id string! Supplier identifier
        supplier_name string! Supplier name
        country_of_origin string! Country of origin
        base_uom string! Unit of measure
        net_content string! Net content
        net_weight_kg double! Net weight in kg
        base_cost double! Cost of one unit
        list_price double! List price of one unit
        tax_rate_pct double! Tax rate in percent
        discountable string! Y when discounts apply
        in_stores string! Y when sold in stores
        in_ecommerce string! Y when sold online
        distribution_center_id string! Distribution centre
        distribution_center_name string! Name of the centre
        replenishment_type string! Way of replenishment
        lead_time_days bigint! Days from order to delivery
    """),
)

DATE_DIMENSIONS = TableSpec(
    name="date_dimensions",
    comment="Retail calendar, one row per day",
    keys=("date_key",),
    date_format="dd-MM-yyyy",
    schema=schema_of("""
        date_key bigint! Day as YYYYMMDD
        full_date date! Day
        calendar_year bigint! Calendar year
        calendar_quarter bigint! Quarter 1 to 4
        calendar_quarter_name string! Quarter label
        month_number bigint! Month 1 to 12
        month_name string! Month name
        month_short string! Month abbreviation
        year_month string! Year and month
        month_year_label string! Month and year label
        week_of_year bigint! ISO week
        year_week string! Calendar year and ISO week
        day_of_month bigint! Day in the month
        day_of_week_number bigint! Weekday, Monday is 1
        day_of_week_name string! Weekday name
        day_of_week_short string! Weekday abbreviation
        day_of_year bigint! Day in the year
        fiscal_year bigint! Fiscal year
        fiscal_year_label string! Fiscal year label
        fiscal_quarter bigint! Fiscal quarter
        fiscal_quarter_name string! Fiscal quarter label
        fiscal_month bigint! Fiscal month
        fiscal_period string! Fiscal period label
        retail_season string! Season
        promotional_period string! Promotion running on the day
        is_weekend string! Y on Saturday and Sunday
        is_working_day string! Y on working days
        is_holiday string! Y on public holidays
        holiday_name string Name of the holiday
        is_month_start string! Y on the first day of a month
        is_month_end string! Y on the last day of a month
        is_quarter_start string! Y on the first day of a quarter
        is_quarter_end string! Y on the last day of a quarter
        is_year_start string! Y on 1 January
        is_year_end string! Y on 31 December
        is_fiscal_year_start string! Y on the first fiscal day
        is_fiscal_year_end string! Y on the last fiscal day
        month_sort bigint! Sort key of the month
        day_of_week_sort bigint! Sort key of the weekday
    """),
)

SUGGESTIONS = TableSpec(
    name="metadata_suggestions",
    comment="Suggested description changes and their review",
    keys=("change_id",),
    schema=schema_of("""
        suggestion_date timestamp Time of submission
        suggestor_id string Submitter
        catalog string Catalog of the asset
        schema string Schema of the asset
        asset string Table or view name
        asset_type string Table, view or materialized view
        suggestion_format string Table or column description
        suggestion_on string Table or column the text is for
        suggestion string Suggested text
        suggestion_type string Add new, modify or delete
        status string Pending, approved or rejected
        reviewer_id string Reviewer
        review_date timestamp Time of review
        reviewer_comments string Remarks of the reviewer
        change_id string Identifier of the change
        synced_to_uc boolean True once written to the catalog
    """),
)

METADATA_KPIS = TableSpec(
    name="metadata_kpis",
    comment="Cached description coverage figures and leaderboards",
    schema=schema_of("""
        refresh_timestamp timestamp Time of the refresh
        metric_name string Name of the figure
        metric_value bigint Value of a coverage figure
        metric_percentage double Share of all tables
        user_id string Normalised user of a board row
        user_count bigint Count of a board row
        user_rank int Rank of a board row
    """),
)

ALL_SPECS = (TRANSACTIONS, TRANSACTIONS_KEYED, RETAIL_ARTICLES, DATE_DIMENSIONS, SUGGESTIONS, METADATA_KPIS)

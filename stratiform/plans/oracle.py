"""SQL equivalents of the registered queries, for DuckDB on the same tables.

ROUND on DOUBLE differs between engines, so ratios are rounded through their decimal text, which is
what Spark's HALF_UP does.
"""

from __future__ import annotations

AUDIT = "TIMESTAMP '2025-01-01 00:00:00' AS audit_ts"


def audited(source: str) -> str:
    return f"{AUDIT}, '{source}' AS source_system"


def r2(x: str) -> str:
    return f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,2)) AS DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def total(x: str) -> str:
    return f"SUM(CAST({x} AS DECIMAL(18,6)))"


def money(x: str) -> str:
    return f"CAST(ROUND({x}, 2) AS DOUBLE)"


def ratio(a: str, b: str, factor: str = "") -> str:
    return f"({dbl(a)} / NULLIF({dbl(b)}, 0.0)){' * ' + factor if factor else ''}"


def rows_where(condition: str) -> str:
    return f"CAST(COUNT(*) FILTER (WHERE {condition}) AS BIGINT)"


def rate(condition: str) -> str:
    return r2(f"{dbl(rows_where(condition))} * 100.0::DOUBLE / CAST(COUNT(*) AS DOUBLE)")


def initcap(x: str) -> str:
    words = f"string_split(lower(trim({x})), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"


def strip(x: str) -> str:
    return f"regexp_replace(COALESCE({x}, ''), '^\\s+|\\s+$', '', 'g')"


def day_key(d: str) -> str:
    return f"CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS BIGINT)"


NET = "l_extendedprice * (1.0::DOUBLE - l_discount)"
TRANSACTIONS = f"""transactions AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {day_key('l_shipdate')},
           CAST(ROUND(l_extendedprice * 100.0::DOUBLE) AS BIGINT)) AS transaction_id,
    CAST(l_partkey AS VARCHAR) AS article_id, CAST(l_shipdate AS DATE) AS transaction_date,
    {day_key('l_shipdate')} AS date_key, CAST(l_quantity AS BIGINT) AS quantity,
    l_extendedprice / l_quantity AS unit_price,
    CAST(ROUND(l_discount * 100.0::DOUBLE) AS BIGINT) AS discount_pct, {NET} AS net_amount,
    {NET} * (1.0::DOUBLE + l_tax) AS total_amount, r_name AS region,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'online' ELSE 'store' END AS sales_channel,
    CAST(o_custkey AS VARCHAR) AS customer_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ARTICLES = """articles AS (
  SELECT CAST(p_partkey AS VARCHAR) AS article_id, p_name AS article_name, p_brand AS department,
    p_type AS category, string_split(p_name, ' ')[-1] AS subcategory,
    p_retailprice * 0.8::DOUBLE AS base_cost, p_retailprice AS list_price
  FROM part)"""
STAR = f"{TRANSACTIONS}, {ARTICLES}"
SEASON = """CASE WHEN month(transaction_date) BETWEEN 3 AND 5 THEN 'Spring'
    WHEN month(transaction_date) BETWEEN 6 AND 8 THEN 'Summer'
    WHEN month(transaction_date) BETWEEN 9 AND 11 THEN 'Autumn' ELSE 'Winter' END"""

RAW_ARTICLES = """raw AS (
  SELECT ' ' || p_partkey || '  ' AS article_id, lower(p_brand) AS department, ' ' || p_type AS category,
    upper(p_name) AS subcategory,
    CASE p_size % 6 WHEN 0 THEN 'Active' WHEN 1 THEN ' blocked ' WHEN 2 THEN 'PENDING'
      WHEN 3 THEN 'Discontinued' WHEN 4 THEN 'retired' END AS status,
    CASE WHEN p_size % 13 = 0 THEN 'n/a' WHEN p_size % 17 <> 0 THEN CAST(CAST(p_retailprice *
      CASE WHEN p_size % 11 = 0 THEN 1.1::DOUBLE ELSE 0.8::DOUBLE END AS DECIMAL(18,2)) AS VARCHAR) END AS base_cost,
    CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS list_price
  FROM part)"""
RAW_TRANSACTIONS = f"""{TRANSACTIONS}, raw AS (
  SELECT transaction_id, article_id,
    CASE WHEN (quantity + discount_pct) % 19 <> 0 THEN CAST(quantity AS INTEGER) END AS quantity,
    CASE WHEN (quantity + discount_pct) % 23 = 0 THEN -unit_price ELSE unit_price END AS unit_price, total_amount
  FROM transactions), checked AS (
  SELECT *, CASE WHEN quantity IS NULL THEN 'MISSING_QUANTITY' WHEN unit_price < 0 THEN 'NEGATIVE_PRICE'
    ELSE 'CLEAN' END AS data_quality_flag FROM raw)"""

SILVER_TRANSACTIONS = f"""WITH {RAW_TRANSACTIONS} SELECT *, {audited('silver_transformation')} FROM checked
  WHERE quantity > 0 AND unit_price >= 0 AND total_amount >= 0"""

OPERATION = "CASE event_type WHEN 'signup' THEN 'c' WHEN 'purchase' THEN 'r' WHEN 'error' THEN 'd' ELSE 'u' END"
CLASSIFIED = f"""raw AS (
  SELECT CASE WHEN event_id % 97 <> 0 THEN user_id END AS user_id, event_id, event_type AS kind,
    CASE WHEN event_id % 101 <> 0 THEN value END AS value,
    CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'x' ELSE {OPERATION} END AS cdc_operation,
    (epoch_us(ts) // 1000) AS cdc_timestamp_ms, event_id % 101 = 0 OR event_id % 103 = 0 AS mismatch
  FROM events), classified AS (
  SELECT *, CASE WHEN user_id IS NULL THEN 'NULL_PRIMARY_KEY'
    WHEN cdc_operation IS NULL OR cdc_operation NOT IN ('c', 'u', 'd', 'r') THEN 'INVALID_CDC_OPERATION'
    WHEN mismatch THEN 'SCHEMA_MISMATCH' END AS quarantine_reason FROM raw)"""
CHANGES = f"""changes AS (
  SELECT user_id, event_id, event_type AS kind, value, {OPERATION} AS op, make_timestamp_ms((epoch_us(ts) // 1000)) AS seq
  FROM events), versions AS (
  SELECT * FROM changes QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, seq ORDER BY event_id DESC) = 1)"""
SCD1 = f"""WITH {CHANGES}, latest AS (
  SELECT * FROM versions QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1)
  SELECT user_id, event_id, kind, value FROM latest WHERE op <> 'd'"""
SCD2 = f"""WITH {CHANGES}, spans AS (
  SELECT *, LEAD(seq) OVER (PARTITION BY user_id ORDER BY seq) AS next_seq FROM versions)
  SELECT user_id, event_id, kind, value, seq AS __START_AT, next_seq AS __END_AT FROM spans WHERE op <> 'd'"""
REASONS = f"""WITH {CLASSIFIED} SELECT COALESCE(quarantine_reason, 'VALID') AS outcome, COUNT(*) AS row_count
  FROM classified GROUP BY 1"""
BRONZE_EVENTS = f"""SELECT user_id, event_id, event_type, value, ts, {audited('ecommerce')}
  FROM events WHERE event_id % 97 <> 0"""

BRONZE_FILES = f"SELECT *, TRUE AS _source_file FROM ({BRONZE_EVENTS})"

MEASURED = """measured AS (
  SELECT CAST(ts AS DATE) AS date, CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'app' END AS channel,
    CASE WHEN user_id % 3 = 0 THEN 'gold' ELSE 'basic' END AS tier, user_id, event_type, value,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS quantity,
    CASE WHEN value < 5.0 THEN 'LOW_VALUE' ELSE 'CLEAN' END AS data_quality_flag FROM events)"""


def daily(checked: bool = False) -> str:
    """`checked`: in place of the distinct count and its ratios, that the estimate is close."""
    users = "COUNT(DISTINCT user_id)"
    amount = total("value")
    entity = f"""{users} AS unique_users, {r2(ratio(amount, users))} AS amount_per_user,
    {r2(ratio('COUNT(*)', users))} AS records_per_user"""
    return f"""WITH {MEASURED} SELECT date, channel, tier, {"TRUE AS unique_users_close" if checked else entity},
    COUNT(*) AS user_count,
    {rows_where("event_type <> 'error'")} AS active_user_count, CAST(SUM(quantity) AS BIGINT) AS total_quantity,
    {money(amount)} AS total_amount, {r2(ratio(amount, 'COUNT(value)'))} AS avg_amount,
    {rate("event_type = 'purchase'")} AS purchase_rate_pct, {rate("data_quality_flag = 'CLEAN'")} AS clean_data_rate_pct,
    {audited('gold_aggregation')} FROM measured GROUP BY date, channel, tier"""


def _retail() -> str:
    revenue, cost = total("total_amount"), total("quantity * base_cost")
    pct = ratio(f"({revenue} - {cost})", revenue, "100.0::DOUBLE")
    return f"""WITH {STAR} SELECT transaction_date AS date, strftime(transaction_date, '%Y-%m') AS year_month,
    {SEASON} AS retail_season, department, category, region,
    COUNT(DISTINCT transaction_id) AS transaction_count, CAST(SUM(quantity) AS BIGINT) AS total_units_sold,
    COUNT(DISTINCT customer_id) AS unique_customers, {money(revenue)} AS gross_revenue,
    {r2(ratio(revenue, 'COUNT(*)'))} AS avg_transaction_value, {money(cost)} AS total_cost,
    {money(f'{revenue} - {cost}')} AS gross_profit, {r2(pct)} AS profit_margin_pct,
    CASE WHEN {revenue} - {cost} < 0 THEN 'LOSS' WHEN {pct} < 10 THEN 'LOW_MARGIN'
      WHEN {pct} >= 30 THEN 'HIGH_MARGIN' ELSE 'NORMAL' END AS performance_indicator,
    {audited('gold_aggregation')}
    FROM transactions JOIN articles USING (article_id)
    GROUP BY transaction_date, 2, 3, department, category, region"""


def _category(checked: bool = False) -> str:
    gross, net, cost = total("total_amount"), total("net_amount"), total("quantity * base_cost")
    sales, people = "COUNT(DISTINCT transaction_id)", "COUNT(DISTINCT customer_id)"
    profit = f"({net} - {cost})"
    return f"""WITH {STAR} SELECT transaction_date AS sale_date, department, category, subcategory, region,
    sales_channel, {sales} AS transaction_count, CAST(SUM(quantity) AS BIGINT) AS total_units_sold,
    {"TRUE AS unique_customers_close" if checked else f"{people} AS unique_customers"}, {money(gross)} AS gross_revenue, {money(net)} AS net_revenue,
    {r2(ratio(gross, 'COUNT(*)'))} AS avg_transaction_value, {money(profit)} AS gross_profit,
    {r2(ratio(profit, net, '100.0::DOUBLE'))} AS profit_margin_pct,
    {r2(ratio('SUM(quantity)', sales))} AS units_per_transaction,
    {"" if checked else f"{r2(ratio(net, people))} AS revenue_per_customer,"} {audited('gold_aggregation')}
    FROM transactions JOIN articles USING (article_id)
    GROUP BY transaction_date, department, category, subcategory, region, sales_channel"""


def _calendar() -> str:
    fm = "((month(d) + 10) % 12 + 1)"
    fy = "(year(d) + CASE WHEN month(d) >= 2 THEN 1 ELSE 0 END)"
    fq = f"(({fm} - 1) // 3 + 1)"
    md = "(month(d) * 100 + day(d))"
    # weekday of 1 November decides the fourth Thursday; Black Friday Week starts three days before it
    nov = "make_date(year(d), 11, 1)"
    monday = f"({nov} + CAST((4 - isodow({nov}) + 7) % 7 + 21 - 3 AS INTEGER))"
    holiday = f"""CASE WHEN {md} = 101 THEN 'New Year''s Day' WHEN {md} = 1225 THEN 'Christmas Day'
      WHEN {md} = 1226 THEN 'Boxing Day'
      WHEN month(d) = 8 AND isodow(d) = 1 AND day(d) >= 25 THEN 'August Bank Holiday' END"""
    promo = f"""CASE WHEN d BETWEEN {monday} AND {monday} + 6 THEN 'Black Friday Week'
      WHEN {md} BETWEEN 701 AND 731 THEN 'Summer Sale' WHEN {md} BETWEEN 815 AND 915 THEN 'Back to School'
      WHEN {md} BETWEEN 1201 AND 1224 THEN 'Christmas Trading'
      WHEN {md} >= 1226 OR {md} <= 102 THEN 'Boxing Day Sales' WHEN {md} BETWEEN 103 AND 131 THEN 'January Sale'
      ELSE 'Regular Trading' END"""
    week = "lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0')"

    def yn(condition: str) -> str:
        return f"CASE WHEN {condition} THEN 'Y' ELSE 'N' END"

    def edges(unit: str) -> str:
        return (
            f"{yn(f'''d = date_trunc('{unit}', d)''')} AS is_{unit}_start, "
            f"{yn(f'''d + 1 = date_trunc('{unit}', d + 1)''')} AS is_{unit}_end"
        )

    def big(x: str, name: str) -> str:
        return f"CAST({x} AS BIGINT) AS {name}"

    return f"""WITH span AS (SELECT MIN(CAST(l_shipdate AS DATE)) AS a, MAX(CAST(l_shipdate AS DATE)) AS b FROM lineitem),
    days AS (SELECT CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span)
    SELECT {day_key('d')} AS date_key, d AS full_date, {big('year(d)', 'calendar_year')},
    {big('quarter(d)', 'calendar_quarter')}, 'Q' || quarter(d) AS calendar_quarter_name,
    {big('month(d)', 'month_number')}, strftime(d, '%B') AS month_name, strftime(d, '%b') AS month_short,
    strftime(d, '%Y-%m') AS year_month, strftime(d, '%b %Y') AS month_year_label,
    {big('weekofyear(d)', 'week_of_year')}, year(d) || '-W' || {week} AS year_week,
    {big('day(d)', 'day_of_month')}, {big('isodow(d)', 'day_of_week_number')}, strftime(d, '%A') AS day_of_week_name,
    strftime(d, '%a') AS day_of_week_short, {big('dayofyear(d)', 'day_of_year')}, {big(fy, 'fiscal_year')},
    'FY' || {fy} AS fiscal_year_label, {big(fq, 'fiscal_quarter')}, 'FQ' || {fq} AS fiscal_quarter_name,
    {big(fm, 'fiscal_month')}, 'P' || lpad(CAST({fm} AS VARCHAR), 2, '0') AS fiscal_period,
    {SEASON.replace('transaction_date', 'd')} AS retail_season, {promo} AS promotional_period,
    {yn('isodow(d) >= 6')} AS is_weekend, {yn('isodow(d) < 6')} AS is_working_day,
    {yn(f'({holiday}) IS NOT NULL')} AS is_holiday, {holiday} AS holiday_name,
    {edges('month')}, {edges('quarter')}, {edges('year')},
    {yn('month(d) = 2 AND day(d) = 1')} AS is_fiscal_year_start, {yn('month(d) = 1 AND day(d) = 31')} AS is_fiscal_year_end,
    {big('month(d)', 'month_sort')}, {big('isodow(d)', 'day_of_week_sort')},
    isoyear(d) || '-W' || {week} AS iso_year_week FROM days"""


# CSV loads

LINES = TRANSACTIONS.replace(
    "r_name AS region,",
    """r_name AS region, CAST(l_suppkey AS VARCHAR) AS store_id, s_name AS store_name,
    CASE WHEN s_nationkey % 2 = 0 THEN 'superstore' ELSE 'local' END AS store_type,
    CAST(l_orderkey AS VARCHAR) AS basket_id, l_orderkey % 101 = 0 AS bad_quantity, l_partkey % 103 = 0 AS bad_day,""",
)


def _load_transactions() -> str:
    return f"""WITH {LINES} SELECT * EXCLUDE (bad_quantity, bad_day, net_amount) REPLACE (
      CASE WHEN NOT bad_quantity THEN quantity END AS quantity, CASE WHEN NOT bad_day THEN date_key END AS date_key,
      CASE WHEN NOT bad_day THEN transaction_date END AS transaction_date) FROM transactions"""


def _load_articles() -> str:
    key = "CAST(p_partkey AS VARCHAR)"
    day = "DATE '2020-01-01' + p_size"
    return f"""SELECT {key} AS article_id, CASE WHEN p_size % 2 = 0 THEN 'ACTIVE' ELSE 'BLOCKED' END AS status,
    CASE WHEN p_partkey % 61 <> 0 THEN CAST({day} AS DATE) END AS valid_from,
    CASE WHEN p_size % 3 = 0 THEN CAST({day} + 365 AS DATE) END AS valid_to,
    CASE WHEN p_size % 5 <> 0 THEN 'core' END AS lifecycle_group, p_brand AS department, p_type AS category,
    string_split(p_name, ' ')[-1] AS subcategory, p_brand AS brand, p_name || ', "' || p_size || '"' AS article_name,
    CAST(NULL AS VARCHAR) AS short_description, CAST(p_partkey % 100 AS VARCHAR) AS supplier_id,
    'Supplier ' || (p_partkey % 100) AS supplier_name, 'GB' AS country_of_origin, 'EA' AS base_uom,
    p_size || ' g' AS net_content, CASE WHEN p_partkey % 53 <> 0 THEN p_size / 8.0::DOUBLE END AS net_weight_kg,
    p_retailprice * 0.8::DOUBLE AS base_cost, p_retailprice AS list_price, 20.0::DOUBLE AS tax_rate_pct,
    'Y' AS discountable, 'Y' AS in_stores, CASE WHEN p_size % 4 = 0 THEN 'Y' ELSE 'N' END AS in_ecommerce,
    CAST(p_size % 6 AS VARCHAR) AS distribution_center_id, 'DC ' || (p_size % 6) AS distribution_center_name,
    'daily' AS replenishment_type, CASE WHEN p_partkey % 59 <> 0 THEN CAST(p_size % 7 AS BIGINT) END AS lead_time_days
    FROM part"""


def _load_dates() -> str:
    return f"""SELECT * EXCLUDE (iso_year_week) REPLACE (CASE WHEN day_of_month <> 13 THEN week_of_year END AS week_of_year,
      CASE WHEN NOT (month_number = 2 AND day_of_month = 29) THEN full_date END AS full_date) FROM ({_calendar()})"""


def _load_reports() -> str:
    def report(source: str, table: str, refused: dict[str, str]) -> str:
        return " UNION ALL ".join(
            f"SELECT '{table}' AS table_name, COUNT(*) AS row_count, '{c}' AS column_name, {rows_where(w)} AS rejected_count FROM {source}"
            for c, w in refused.items()
        )

    numbers = [c for c in ("calendar_year calendar_quarter month_number day_of_month day_of_week_number day_of_year fiscal_year "
        "fiscal_quarter fiscal_month month_sort day_of_week_sort date_key _line").split()]  # fmt: skip
    sales = {"transaction_date": "bad_day", "quantity": "bad_quantity"}
    sales |= dict.fromkeys(["unit_price", "discount_pct", "total_amount", "_line"], "FALSE")
    goods = {"valid_from": "p_partkey % 61 = 0", "net_weight_kg": "p_partkey % 53 = 0", "lead_time_days": "p_partkey % 59 = 0"}
    goods |= dict.fromkeys(["valid_to", "base_cost", "list_price", "tax_rate_pct", "_line"], "FALSE")
    days = {"full_date": "month_number = 2 AND day_of_month = 29", "week_of_year": "day_of_month = 13"}
    days |= dict.fromkeys(numbers, "FALSE")
    return f"WITH {LINES}, days_of AS ({_calendar()}) " + " UNION ALL ".join(
        [report("transactions", "transactions", sales), report("part", "retail_articles", goods), report("days_of", "date_dimensions", days)]
    )


# Inventory and ledger


def catalog_of(n: str) -> str:
    return f"'cat_' || ({n} % 3)"


def schema_of(n: str) -> str:
    return f"CASE WHEN {n} % 50 = 7 THEN 'information_schema' ELSE 'sch_' || ({n} % 5) END"


def name_of(n: str) -> str:
    prefix = f"CASE {n} % 4 WHEN 0 THEN 'bronze_t_' WHEN 1 THEN 'silver_t_' WHEN 2 THEN 'gold_t_' ELSE 'Orders-' END"
    return f"({prefix}) || {n}"


def table_names(n: str) -> str:
    return f"{catalog_of(n)} AS table_catalog, {schema_of(n)} AS table_schema, {name_of(n)} AS table_name"


def type_of(n: str) -> str:
    return (
        f"CASE {n} % 5 WHEN 0 THEN 'MANAGED' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'MATERIALIZED_VIEW' "
        f"WHEN 3 THEN 'STREAMING_TABLE' ELSE 'EXTERNAL' END"
    )


def asset_type_of(n: str) -> str:
    return f"CASE {n} % 5 WHEN 1 THEN 'view' WHEN 2 THEN 'materialized view' ELSE 'table' END"


INV_TABLES = f"""inv_tables AS (
  SELECT {table_names('o_orderkey')}, {type_of('o_orderkey')} AS table_type,
    CASE o_orderkey % 3 WHEN 2 THEN 'Orders by ' || o_orderpriority WHEN 1 THEN '' END AS comment,
    o_orderkey AS n FROM orders)"""
INV_COLUMNS = f"""inv_columns AS (
  SELECT {table_names('l_orderkey')}, 'col_' || l_linenumber AS column_name, l_linenumber AS ordinal,
    'double' AS data_type,
    CASE WHEN l_orderkey % 5 = 0 THEN 'Measure' WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN ''
      WHEN (l_orderkey + l_linenumber) % 4 = 1 THEN 'Line ' || l_linenumber
      WHEN (l_orderkey + l_linenumber) % 4 = 2 THEN 'Measure' END AS comment
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
  UNION ALL
  SELECT {table_names('o_orderkey')}, c.column_name, c.ordinal, c.data_type, 'Standard column' AS comment
  FROM orders, (VALUES ('data_quality_flag', 8, 'string'), ('audit_ts', 9, 'timestamp'),
    ('source_system', 10, 'string')) AS c(column_name, ordinal, data_type) WHERE o_orderkey % 2 = 0)"""
ASSET_NO = "(event_id // 8)"
LEDGER = f"""base AS (
  SELECT *, CASE WHEN event_id % 211 = 0 THEN 'escalated' WHEN event_type = 'view' THEN 'pending'
    WHEN event_type IN ('click', 'purchase') THEN 'approved' ELSE 'rejected' END AS status FROM events),
  ledger AS (
  SELECT ts AS suggestion_date,
    'user_' || user_id || CASE WHEN event_id % 2 = 0 THEN '@corp.example' ELSE '' END AS suggestor_id,
    {catalog_of(ASSET_NO)} AS catalog, {schema_of(ASSET_NO)} AS schema, {name_of(ASSET_NO)} AS asset,
    {asset_type_of(ASSET_NO)} AS asset_type,
    CASE WHEN event_id % 4 = 0 THEN 'table description' ELSE 'column description' END AS suggestion_format,
    CASE WHEN event_id % 4 = 0 THEN {name_of(ASSET_NO)} ELSE 'col_' || (event_id % 3 + 1) END AS suggestion_on,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'Orders by 5-LOW'
      WHEN event_id % 11 = 1 THEN 'Measure' ELSE 'It''s change ' || event_id END AS suggestion,
    CASE event_id % 13 WHEN 0 THEN 'delete' WHEN 1 THEN 'add new' ELSE 'modify' END AS suggestion_type, status,
    CASE WHEN status IN ('approved', 'rejected') THEN 'reviewer_' || (user_id % 10) ||
      CASE WHEN event_id % 5 = 0 THEN '@corp.example' ELSE '' END END AS reviewer_id,
    CASE WHEN status IN ('approved', 'rejected') THEN ts + INTERVAL 1 DAY END AS review_date,
    CASE WHEN status IN ('approved', 'rejected') AND event_id % 3 = 0 THEN 'looks fine' END AS reviewer_comments,
    'change_' || event_id AS change_id,
    CASE WHEN status = 'approved' AND event_id % 2 = 0 THEN TRUE WHEN status = 'approved' AND event_id % 5 = 0
      THEN FALSE END AS synced_to_uc
  FROM base)"""
TARGET = "catalog, schema, asset, suggestion_format, suggestion_on"
DECIDED = f"""{LEDGER}, decided AS (
  SELECT change_id, CASE WHEN n % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, 'lead_' || (n % 4) AS reviewer_id,
    COALESCE(review_date, suggestion_date) + INTERVAL 2 DAY AS review_date,
    CASE WHEN status = 'pending' THEN 'first look' ELSE 'second look' END AS reviewer_comments
  FROM (SELECT *, CAST(string_split(change_id, '_')[-1] AS BIGINT) AS n FROM ledger))"""
PREPARED = f"""requests AS (
  SELECT conv_id * 2147483648 + turn AS request_id, {catalog_of('conv_id')} AS catalog, {schema_of('conv_id')} AS schema,
    {name_of('conv_id')} AS asset, CASE WHEN turn > 0 THEN 'col_' || (turn % 3 + 1) END AS column_name, turn,
    CASE turn % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'Old text' END AS old_value,
    CASE WHEN turn % 5 = 4 THEN ' ' || chr(10) ELSE text END AS new_value, role || '_' || (conv_id % 7) AS suggestor_id,
    {asset_type_of('conv_id')} AS asset_type
  FROM conversations), prepared AS (
  SELECT request_id, CASE WHEN turn > 0 THEN 'column `' || column_name || '`' ELSE 'table description' END AS target,
    TIMESTAMP '2024-06-01 00:00:00' AS suggestion_date, suggestor_id, catalog, schema, asset, asset_type,
    CASE WHEN turn = 0 THEN 'table description' ELSE 'column description' END AS suggestion_format,
    COALESCE(column_name, asset) AS suggestion_on, new_value AS suggestion,
    CASE WHEN {strip('old_value')} = '' THEN 'add new' WHEN {strip('new_value')} = '' THEN 'delete' ELSE 'modify' END
      AS suggestion_type, 'pending' AS status FROM requests)"""
SUBMITTED = f"""{LEDGER}, {PREPARED}, firsts AS (
  SELECT * FROM prepared QUALIFY ROW_NUMBER() OVER (PARTITION BY {TARGET} ORDER BY request_id) = 1),
  accepted AS (SELECT f.* FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.status = 'pending'
    AND l.catalog = f.catalog AND l.schema = f.schema AND l.asset = f.asset
    AND l.suggestion_format = f.suggestion_format AND l.suggestion_on = f.suggestion_on))"""
ITEMS = f"""{INV_TABLES}, {INV_COLUMNS}, items AS (
  SELECT table_catalog AS catalog, table_schema AS schema, table_name AS asset,
    'table description' AS suggestion_format, table_name AS suggestion_on, table_type AS type, comment FROM inv_tables
  UNION ALL
  SELECT table_catalog, table_schema, table_name, 'column description', column_name, data_type, comment
  FROM inv_columns)"""
BEST = f"""{LEDGER}, best AS (
  SELECT {TARGET}, status, COALESCE(suggestion, '') AS suggestion, suggestor_id, suggestion_date, suggestion_type,
    COALESCE(synced_to_uc, FALSE) AS synced_to_uc FROM ledger
  QUALIFY ROW_NUMBER() OVER (PARTITION BY {TARGET} ORDER BY CASE status WHEN 'pending' THEN 1 WHEN 'approved' THEN 2
    WHEN 'rejected' THEN 3 ELSE 4 END, suggestion_date DESC, change_id) = 1)"""
UNSYNCED = "status = 'approved' AND NOT COALESCE(synced_to_uc, FALSE)"
NEW_TEXT = "CASE WHEN suggestion_type = 'delete' THEN '' ELSE COALESCE(suggestion, '') END"
LAST = f"""last AS (SELECT *, {NEW_TEXT} AS new_text FROM (SELECT * FROM ledger WHERE status = 'approved'
  QUALIFY ROW_NUMBER() OVER (PARTITION BY {TARGET} ORDER BY review_date DESC, suggestion_date DESC, change_id DESC) = 1)
  WHERE NOT COALESCE(synced_to_uc, FALSE))"""


def ticked(x: str) -> str:
    return f"'`' || replace({x}, '`', '``') || '`'"


PLAN = f"""{LEDGER}, {LAST}, plan AS (
  SELECT change_id, CASE WHEN suggestion_format = 'table description'
    THEN 'COMMENT ON ' || upper(asset_type) || ' ' || full_name || ' IS ' || quoted
    WHEN asset_type = 'table' THEN 'ALTER TABLE ' || full_name || ' ALTER COLUMN ' || {ticked('suggestion_on')} || ' COMMENT ' || quoted
    ELSE 'COMMENT ON COLUMN ' || full_name || '.' || {ticked('suggestion_on')} || ' IS ' || quoted END AS statement
  FROM (SELECT *, {ticked('catalog')} || '.' || {ticked('schema')} || '.' || {ticked('asset')} AS full_name,
    '''' || replace(replace(new_text, chr(92), chr(92) || chr(92)), '''', '''''') || '''' AS quoted FROM last))"""
WRITTEN = f"{LEDGER}, {INV_TABLES}, {INV_COLUMNS}, {LAST}, texts AS (SELECT {TARGET}, new_text FROM last)"
DETAILS = """catalog, schema, asset, asset_type, suggestion_format, suggestion_on, suggestion, suggestion_type, status,
    reviewer_id, review_date, reviewer_comments, change_id"""


def person(x: str) -> str:
    return f"split_part({x}, '@', 1)"


BOARDS = f"""{LEDGER}, entries AS (
  SELECT 'top_suggestor' AS metric_name, {person('suggestor_id')} AS user_id FROM ledger
  UNION ALL SELECT 'top_reviewer', {person('reviewer_id')} FROM ledger WHERE reviewer_id IS NOT NULL
  UNION ALL SELECT 'top_rejected_suggestor', {person('suggestor_id')} FROM ledger WHERE status = 'rejected'),
  boards AS (
  SELECT metric_name, user_id, COUNT(*) AS user_count,
    CAST(ROW_NUMBER() OVER (PARTITION BY metric_name ORDER BY COUNT(*) DESC, user_id) AS INTEGER) AS user_rank
  FROM entries GROUP BY metric_name, user_id QUALIFY user_rank <= 3)"""
ALLOWED = """table_schema NOT IN ('information_schema', 'system') AND (table_catalog = 'cat_0'
    OR (table_catalog = 'cat_1' AND table_schema IN ('sch_0', 'sch_1', 'sch_2')))"""
COVERAGE = f"""{INV_TABLES}, {INV_COLUMNS}, per_table AS (
  SELECT COUNT(*) AS all_columns, COUNT(*) FILTER (WHERE COALESCE(comment, '') <> '') AS described
  FROM inv_columns WHERE {ALLOWED} GROUP BY table_catalog, table_schema, table_name), figures AS (
  SELECT (SELECT COUNT(*) FROM inv_tables WHERE {ALLOWED}) AS t,
    (SELECT COUNT(*) FROM inv_tables WHERE {ALLOWED} AND COALESCE(comment, '') <> '') AS d,
    COUNT(*) FILTER (WHERE all_columns = described) AS a,
    COUNT(*) FILTER (WHERE described > 0 AND described < all_columns) AS p FROM per_table)"""


EVERY_COVERAGE = COVERAGE.replace(ALLOWED, "table_schema NOT IN ('information_schema', 'system')")


def _kpi_row(name: str, column: str) -> str:
    pct = "NULL" if column == "t" else f"CASE WHEN t > 0 THEN {dbl(column)} / {dbl('t')} * 100.0::DOUBLE ELSE 0.0 END"
    return (
        f"SELECT '{name}' AS metric_name, {column} AS metric_value, CAST({pct} AS DOUBLE) AS metric_percentage, "
        f"NULL AS user_id, NULL AS user_count, NULL AS user_rank FROM figures"
    )


def _kpis() -> str:
    rows = [("total_tables", "t"), ("tables_with_desc", "d"), ("tables_all_cols_desc", "a"), ("tables_partial_cols_desc", "p")]
    lines = " UNION ALL ".join(_kpi_row(n, c) for n, c in rows)
    return f"""WITH {BOARDS}, {COVERAGE} SELECT TIMESTAMP '2025-01-01 00:00:00' AS refresh_timestamp, * FROM ({lines}
    UNION ALL SELECT metric_name, NULL, NULL, user_id, user_count, user_rank FROM boards)"""


def _conformance() -> str:
    key = "table_catalog, table_schema, table_name"
    even = "n % 2 = 0"
    rules = [
        ("name", "n % 4 <> 3"),
        ("audit_columns_last", even),
        ("comment", "COALESCE(comment, '') <> ''"),
        ("properties", "n % 4 <> 3 AND n % 6 <> 0 AND (n % 4 <> 1 OR n % 9 <> 0)"),
        ("kind", "n % 5 IN (2, 3)"),
        ("quality_flag", f"n % 4 <> 1 OR {even}"),
        ("rules_in_silver_only", f"n % 4 = 1 OR {even}"),
        ("source_system", "n % 4 <> 3 AND n % 7 <> 0"),
    ]
    return f"WITH {INV_TABLES} " + " UNION ALL ".join(
        f"SELECT {key}, '{name}' AS rule, {passed} AS passed FROM inv_tables" for name, passed in rules
    )


def _report(rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS rule, '{a}' AS action, {rows_where(f'NOT COALESCE({c}, FALSE)')} AS violations, "
        f"COUNT(*) AS rows_checked FROM checked"
        for n, a, c in rules
    )


def _collapsed() -> str:
    return f"""WITH {CHANGES}, marked AS (
  SELECT *, CASE WHEN LAG(kind) OVER w IS NULL OR LAG(kind) OVER w <> kind OR LAG(op) OVER w <> op
    THEN 1 ELSE 0 END AS changed FROM versions WINDOW w AS (PARTITION BY user_id ORDER BY seq)), kept AS (
  SELECT *, LEAD(seq) OVER (PARTITION BY user_id ORDER BY seq) AS next_seq FROM marked WHERE changed = 1)
  SELECT user_id, event_id, kind, seq AS __START_AT, next_seq AS __END_AT FROM kept WHERE op <> 'd'"""


def _kpi_counts(column: str, first: str, pending: bool) -> str:
    states = (["pending"] if pending else []) + ["approved", "rejected"]
    counts = ", ".join(f"{rows_where(f'''status = '{s}' ''')} AS {s}_count" for s in states)
    return f"""WITH {LEDGER} SELECT {person(column)} AS user_id, COUNT(*) AS {first}, {counts}
    FROM ledger WHERE {column} IS NOT NULL GROUP BY 1"""


def _review(pending_only: bool) -> str:
    hit = "l.status = 'pending'" if pending_only else "TRUE"

    def new(c: str) -> str:
        return f"CASE WHEN {hit} THEN d.{c} ELSE l.{c} END AS {c}"

    return f"""WITH {DECIDED} SELECT l.* REPLACE ({new('status')}, {new('reviewer_id')}, {new('review_date')},
    {new('reviewer_comments')}) FROM ledger l JOIN decided d USING (change_id)"""


_JOIN_TARGET = " AND ".join(f"b.{c} = i.{c}" for c in TARGET.split(", "))
_WAITING = f"""(b.status = 'approved' AND NOT (b.synced_to_uc OR {strip('b.suggestion')} = {strip('i.comment')}))"""


def oracle_sql() -> dict[str, str]:
    return {
        "bronze_copy": f"SELECT *, {audited('ecommerce')} FROM orders WHERE o_orderkey IS NOT NULL",
        "typed_csv_load": f"""WITH {TRANSACTIONS} SELECT date_key, COUNT(*) AS row_count,
            CAST(SUM(quantity) AS BIGINT) AS units, CAST({total('total_amount')} AS DOUBLE) AS total_amount
            FROM transactions GROUP BY date_key""",
        "load_transactions": _load_transactions(),
        "load_articles": _load_articles(),
        "load_dates": _load_dates(),
        "load_reports": _load_reports(),
        "json_stream_bronze": BRONZE_FILES,
        "csv_stream_bronze": BRONZE_FILES,
        "parquet_stream_bronze": BRONZE_FILES,
        "cdc_valid": f"""WITH {CLASSIFIED} SELECT user_id, event_id, kind, value, cdc_operation, cdc_timestamp_ms,
            {audited('ecommerce')} FROM classified WHERE quarantine_reason IS NULL""",
        "cdc_quarantine": f"""WITH {CLASSIFIED} SELECT user_id, event_id, kind, value, cdc_operation, cdc_timestamp_ms,
            mismatch AS _rescued_data, quarantine_reason, TIMESTAMP '2025-01-01 00:00:00' AS quarantined_at,
            {audited('ecommerce')} FROM classified WHERE quarantine_reason IS NOT NULL""",
        "cdc_reason_counts": REASONS,
        "cdc_typed": f"""WITH {CLASSIFIED} SELECT user_id, event_id, kind, CAST(value AS DECIMAL(18,2)) AS value,
            cdc_operation, {audited('ecommerce')}, make_timestamp_ms(cdc_timestamp_ms) AS cdc_timestamp
            FROM classified WHERE quarantine_reason IS NULL AND cdc_operation <> 'd'""",
        "quarantine_stream": REASONS,
        "quarantine_stream_rows": f"""WITH {CLASSIFIED} SELECT user_id, event_id, kind, value, cdc_operation, cdc_timestamp_ms,
            TRUE AS _source_file, CASE WHEN mismatch THEN event_id END AS _rescued_data,
            COALESCE(quarantine_reason, 'VALID') AS outcome,
            CASE WHEN quarantine_reason IS NOT NULL THEN TIMESTAMP '2025-01-01 00:00:00' END AS quarantined_at,
            {audited('ecommerce')} FROM classified""",
        "csv_export": "SELECT * FROM customer",
        "ledger_append": f"""WITH {SUBMITTED}, every AS (SELECT suggestion_type, status FROM ledger
              UNION ALL SELECT suggestion_type, status FROM accepted)
            SELECT suggestion_type, status, COUNT(*) AS row_count, (SELECT COUNT(*) FROM every) AS table_rows
            FROM every GROUP BY 1, 2""",
        "submitted_ids": f"""WITH {SUBMITTED} SELECT COUNT(*) AS row_count, COUNT(*) AS id_count,
            CAST(0 AS BIGINT) AS changed_ids FROM accepted""",
        "pending_sync_view": f"""WITH {LEDGER} SELECT asset_type, COUNT(*) AS row_count FROM ledger
            WHERE {UNSYNCED} GROUP BY 1""",
        "ledger_of_assets": f"WITH {LEDGER} SELECT * FROM ledger WHERE status = 'rejected'",
        "reviewed_flags": f"""WITH {LEDGER} SELECT change_id, COALESCE(review_date > suggestion_date, FALSE) AS is_reviewed,
            COALESCE(synced_to_uc, FALSE) AS is_synced, {audited('ledger')} FROM ledger""",
        "catalog_schemas": f"""WITH {INV_TABLES} SELECT schema_name, ROW_NUMBER() OVER (ORDER BY schema_name)::INT AS place FROM (
            SELECT DISTINCT table_schema AS schema_name FROM inv_tables WHERE table_catalog = 'cat_0'
            AND table_schema NOT IN ('information_schema', 'system') AND NOT starts_with(table_schema, '__'))""",
        "schema_tables": f"""WITH {INV_TABLES} SELECT table_name, table_type, 'cat_1.sch_1.' || table_name AS full_name,
            ROW_NUMBER() OVER (ORDER BY table_name)::INT AS place FROM inv_tables
            WHERE table_catalog = 'cat_1' AND table_schema = 'sch_1'""",
        "coverage_counts": f"""WITH {EVERY_COVERAGE} SELECT t AS total_tables, d AS tables_with_desc, a AS tables_all_cols_desc,
            p AS tables_partial_cols_desc, t - a - p AS tables_no_cols_desc FROM figures""",
        "kpi_listing": f"""WITH {BOARDS}, names AS (SELECT UNNEST(['total_tables', 'tables_with_desc', 'tables_all_cols_desc',
              'tables_partial_cols_desc']) AS metric_name), listed AS (
            SELECT metric_name, NULL AS user_id, NULL AS user_count, NULL AS user_rank FROM names
            UNION ALL SELECT metric_name, user_id, user_count, user_rank FROM boards)
            SELECT *, ROW_NUMBER() OVER (ORDER BY metric_name, user_rank)::INT AS place,
            TIMESTAMP '2025-01-01 00:00:00' AS last_refresh FROM listed""",
        "kpi_metrics": f"""WITH {EVERY_COVERAGE} SELECT UNNEST(['total_tables', 'tables_with_desc', 'tables_all_cols_desc',
            'tables_partial_cols_desc']) AS metric_name, UNNEST([t, d, a, p]) AS metric_value FROM figures""",
        "kpi_board": f"WITH {BOARDS} SELECT user_id, user_count, user_rank FROM boards WHERE metric_name = 'top_reviewer'",
        "scd1_current": SCD1,
        "scd1_stream": SCD1,
        "scd2_history": SCD2,
        "scd2_stream": SCD2,
        "scd2_hot_key": SCD2.replace("SELECT user_id, event_id, event_type AS kind", "SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_id, event_type AS kind"),
        "scd2_collapsed": _collapsed(),
        "change_feed": """WITH new AS (
            SELECT * REPLACE (CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1.0::DOUBLE ELSE c_acctbal END AS c_acctbal)
            FROM customer WHERE c_custkey % 17 <> 0
            UNION ALL SELECT * REPLACE (-c_custkey - 1 AS c_custkey) FROM customer)
            SELECT n.*, 'insert' AS _change_type FROM new n ANTI JOIN customer USING (c_custkey)
            UNION ALL SELECT o.*, 'delete' FROM customer o ANTI JOIN new USING (c_custkey)
            UNION ALL SELECT o.*, 'update_before' FROM customer o JOIN new n USING (c_custkey)
              WHERE o.c_acctbal <> n.c_acctbal
            UNION ALL SELECT n.*, 'update_after' FROM customer o JOIN new n USING (c_custkey)
              WHERE o.c_acctbal <> n.c_acctbal""",
        "silver_articles": f"""WITH {RAW_ARTICLES}, typed AS (
            SELECT *, TRY_CAST(base_cost AS DOUBLE) AS cost, TRY_CAST(list_price AS DOUBLE) AS price FROM raw)
            SELECT trim(article_id) AS article_id, {initcap('department')} AS department, {initcap('category')} AS category,
            {initcap('subcategory')} AS subcategory, upper(trim(status)) AS status, cost AS base_cost, price AS list_price,
            {r2('price - cost')} AS profit_margin,
            {r2('(price - cost) / NULLIF(price, 0.0) * 100.0::DOUBLE')} AS margin_percentage,
            CASE WHEN base_cost IS NULL THEN 'MISSING_COST' WHEN price < cost THEN 'NEGATIVE_MARGIN'
              WHEN status IS NULL THEN 'MISSING_STATUS' ELSE 'CLEAN' END AS data_quality_flag,
            {audited('silver_transformation')} FROM typed WHERE cost >= 0 AND price >= 0
            AND upper(trim(status)) IN ('ACTIVE', 'BLOCKED', 'PENDING', 'DISCONTINUED')""",
        "silver_transactions": SILVER_TRANSACTIONS,
        "silver_transactions_stream": SILVER_TRANSACTIONS,
        "expectation_report": f"WITH {RAW_TRANSACTIONS} "
        + _report(
            [
                ("valid_transaction_id", "fail", "transaction_id IS NOT NULL"),
                ("valid_article_id", "fail", "article_id IS NOT NULL"),
                ("valid_quantity", "drop", "quantity > 0"),
                ("valid_amounts", "drop", "(unit_price >= 0 AND total_amount >= 0)"),
            ]
        ),
        "fail_rule_report": f"""WITH {RAW_TRANSACTIONS} SELECT 'valid_transaction_id' AS rule,
            {rows_where("transaction_id IS NULL OR quantity IS NULL OR quantity = 7")} AS violations,
            {rows_where("quantity > 0 AND unit_price >= 0 AND total_amount >= 0")} AS target_rows FROM checked""",
        "quality_flag_counts": f"""WITH {RAW_TRANSACTIONS} SELECT data_quality_flag, COUNT(*) AS row_count
            FROM checked GROUP BY 1""",
        "pk_violations": """SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count, 'DUPLICATE_KEY' AS violation
            FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
        "fk_orphans": """SELECT l_partkey, COUNT(*) AS row_count FROM lineitem
            WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45) GROUP BY 1""",
        "not_null_report": f"WITH {RAW_ARTICLES} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {rows_where(f'{c} IS NULL')} AS null_count, COUNT(*) AS rows_checked FROM raw"
            for c in ("article_id", "department", "category", "subcategory", "status", "base_cost", "list_price")
        ),
        "date_dimension": _calendar(),
        "sales_by_department_season": f"""WITH {STAR} SELECT department, {SEASON} AS retail_season,
            COUNT(*) AS transaction_count, CAST({total('total_amount')} AS DOUBLE) AS total_revenue
            FROM transactions JOIN articles USING (article_id) GROUP BY 1, 2""",
        "retail_performance": _retail(),
        "category_performance": _category(),
        "category_performance_approx": _category(checked=True),
        "daily_summary_approx": daily(checked=True),
        "users_rolled_up": f"""WITH {MEASURED} SELECT CAST(date_trunc('week', date) AS DATE) AS week, channel,
            COUNT(*) AS record_count, TRUE AS unique_users_close FROM measured GROUP BY 1, 2""",
        "new_files_stream": f"""SELECT *, event_id % 2 + 1 AS start FROM ({BRONZE_FILES})""",
        "late_rows_stream": """SELECT CAST(ts AS DATE) AS date, COUNT(*) AS row_count FROM events
            WHERE NOT (event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-11 00:00:00')
            GROUP BY 1 HAVING CAST(ts AS DATE) + INTERVAL 3 DAY <= (SELECT MAX(ts) FROM events)""",
        "keyed_update": """SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
              CASE WHEN hit THEN o_totalprice + 1.0::DOUBLE ELSE o_totalprice END AS o_totalprice)
            FROM (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS order_month,
              o_orderkey % 97 = 0 AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AS hit FROM orders)""",
        "daily_summary": daily(),
        "daily_summary_stream": daily(),
        "flow_health": f"""WITH log AS (
            SELECT *, CASE WHEN event_type IN ('click', 'view', 'purchase')
              THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) || '000' AS DOUBLE) / 60000.0::DOUBLE END AS minutes
            FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00')
            SELECT CAST(ts AS DATE) AS date, 'line_' || (user_id % 5) AS pipeline_name, 'flow_' || (user_id % 3) AS flow_name,
            'set_' || (user_id % 7) AS dataset_name, COUNT(*) AS event_count,
            COUNT(DISTINCT event_id // 10) AS update_count, {r2(ratio(total('minutes'), 'COUNT(minutes)'))} AS avg_duration_minutes,
            {rows_where("event_type = 'error'")} AS error_count,
            CASE WHEN {rows_where("event_type = 'error'")} = 0 THEN 'GREEN'
              WHEN {rows_where("event_type = 'error'")} <= 2 THEN 'YELLOW' ELSE 'RED' END AS health_status,
            {audited('event_log')} FROM log GROUP BY 1, 2, 3, 4""",
        "exploded_metrics": f"""WITH words AS (
            SELECT doc_id, source, lang, n_chars, UNNEST(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL)
            SELECT word, source, COUNT(DISTINCT doc_id) AS document_count, {money(total('n_chars'))} AS total_amount,
            {r2(ratio(total('n_chars'), 'COUNT(n_chars)'))} AS avg_amount,
            string_agg(DISTINCT lang, ',' ORDER BY lang) AS lang_set FROM words GROUP BY 1, 2""",
        "article_lookup": f"""WITH {STAR} SELECT article_id, transaction_id, CAST(split_part(transaction_id, '-', 1) AS VARCHAR)
            AS basket_id, transaction_date, date_key, quantity, unit_price, discount_pct, net_amount, total_amount,
            article_name, department, category, subcategory, base_cost, list_price
            FROM transactions JOIN articles USING (article_id) ORDER BY transaction_id, total_amount LIMIT 10""",
        "left_join_report": f"""SELECT c.*, CAST(COALESCE(n, 0) AS BIGINT) AS fact_count, {money('COALESCE(t, 0)')} AS total_amount
            FROM customer c LEFT JOIN (SELECT o_custkey, COUNT(*) AS n, {total('o_totalprice')} AS t FROM orders GROUP BY 1)
            ON c_custkey = o_custkey""",
        "ledger_detect_changes": f"""WITH {PREPARED}, {ITEMS}, firsts AS (
            SELECT * FROM prepared QUALIFY ROW_NUMBER() OVER (PARTITION BY {TARGET} ORDER BY request_id) = 1)
            SELECT {', '.join('f.' + c for c in TARGET.split(', '))}, COALESCE(i.comment, '') AS old_value, f.suggestion AS new_value
            FROM firsts f LEFT JOIN items i USING ({TARGET}) WHERE COALESCE(i.comment, '') IS DISTINCT FROM f.suggestion""",
        "ledger_submit": f"""WITH {SUBMITTED} SELECT suggestion_date, suggestor_id, catalog, schema, asset, asset_type,
            suggestion_format, suggestion_on, suggestion, suggestion_type, status, CAST(NULL AS VARCHAR) AS reviewer_id,
            CAST(NULL AS TIMESTAMP) AS review_date, CAST(NULL AS VARCHAR) AS reviewer_comments,
            CAST(NULL AS BOOLEAN) AS synced_to_uc FROM accepted""",
        "ledger_submit_rejected": f"""WITH {SUBMITTED} SELECT request_id, {TARGET}, target,
            'already has a pending change awaiting review' AS reason
            FROM prepared WHERE request_id NOT IN (SELECT request_id FROM accepted)""",
        "ledger_review": _review(False),
        "ledger_review_pending": _review(True),
        "ledger_best": f"WITH {BEST} SELECT * FROM best",
        "ledger_overlay": f"""WITH {BEST}, {ITEMS} SELECT i.catalog, i.schema, i.asset, i.suggestion_format,
            i.suggestion_on AS name, i.type, CASE WHEN {_WAITING} THEN b.suggestion ELSE COALESCE(i.comment, '') END AS comment,
            CASE WHEN {_WAITING} THEN 'approved' WHEN b.status = 'pending' THEN 'pending' END AS status
            FROM items i LEFT JOIN best b ON {_JOIN_TARGET}""",
        "ledger_sync_plan": f"WITH {PLAN} SELECT * FROM plan",
        "ledger_apply_tables": f"""WITH {WRITTEN} SELECT t.table_catalog, t.table_schema, t.table_name, t.table_type,
            COALESCE(x.new_text, t.comment) AS comment FROM inv_tables t LEFT JOIN texts x
            ON x.suggestion_format = 'table description' AND x.catalog = t.table_catalog AND x.schema = t.table_schema
            AND x.asset = t.table_name""",
        "ledger_apply_columns": f"""WITH {WRITTEN} SELECT t.* REPLACE (COALESCE(x.new_text, t.comment) AS comment)
            FROM inv_columns t LEFT JOIN texts x ON x.suggestion_format = 'column description'
            AND x.catalog = t.table_catalog AND x.schema = t.table_schema AND x.asset = t.table_name
            AND x.suggestion_on = t.column_name""",
        "ledger_mark_synced": f"""WITH {PLAN}, done AS (SELECT change_id FROM plan WHERE statement NOT LIKE '%VIEW%')
            SELECT * REPLACE (CASE WHEN change_id IN (SELECT change_id FROM done) THEN TRUE ELSE synced_to_uc END
            AS synced_to_uc) FROM ledger""",
        "ledger_retention": f"""WITH {LEDGER} SELECT * FROM ledger WHERE NOT COALESCE(((status = 'approved' AND synced_to_uc)
            OR status = 'rejected') AND review_date < TIMESTAMP '2024-01-16 00:00:00', FALSE)""",
        "pending_rows": f"WITH {LEDGER} SELECT * FROM ledger WHERE status = 'pending'",
        "not_synced": f"WITH {LEDGER} SELECT * FROM ledger WHERE {UNSYNCED}",
        "pending_queue": f"""WITH {LEDGER} SELECT catalog, schema, asset, COUNT(*) AS change_count,
            MIN(suggestion_date) AS first_submitted FROM ledger WHERE status = 'pending' GROUP BY 1, 2, 3""",
        "pending_by_asset": f"""WITH {LEDGER}, {INV_TABLES} SELECT change_id, suggestion_format, suggestion_on, suggestion,
            suggestion_type, suggestor_id, suggestion_date, asset_type, catalog, schema, asset FROM ledger
            WHERE status = 'pending' AND (catalog, schema, asset) IN
            (SELECT (table_catalog, table_schema, table_name) FROM inv_tables)""",
        "user_history": f"""WITH {LEDGER} SELECT suggestion_date, suggestor_id, {DETAILS} FROM ledger
            WHERE {person('suggestor_id')} IN (SELECT 'user_' || c_custkey FROM customer)""",
        "user_kpis": _kpi_counts("suggestor_id", "total_suggestions", True),
        "reviewer_history": f"""WITH {LEDGER} SELECT suggestion_date, suggestor_id, {DETAILS} FROM ledger
            WHERE reviewer_id IS NOT NULL AND status = 'approved'""",
        "reviewer_kpis": _kpi_counts("reviewer_id", "total_reviews", False),
        "ledger_history": f"""WITH {LEDGER} SELECT suggestor_id, reviewer_id, status, synced_to_uc, COUNT(*) AS change_count
            FROM ledger GROUP BY ALL""",
        "schema_listing": f"""WITH {INV_TABLES} SELECT DISTINCT table_catalog, table_schema AS schema_name FROM inv_tables
            WHERE table_schema NOT IN ('information_schema', 'system') AND NOT starts_with(table_schema, '__')""",
        "metadata_kpis": _kpis(),
        "column_coverage": f"""WITH {INV_COLUMNS} SELECT table_catalog, table_schema, table_name,
            COUNT(*) AS total_columns, {rows_where("COALESCE(comment, '') <> ''")} AS described_columns
            FROM inv_columns GROUP BY 1, 2, 3""",
        "leaderboards": f"WITH {BOARDS} SELECT * FROM boards",
        "conformance": _conformance(),
    }

import time
from datetime import date, datetime, timezone
from pathlib import Path

import pytest
from compare import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.operators.quality import Rule
from stratiform.plans import queries
from stratiform.session import work_folder
from stratiform.sources import inventory
from stratiform.sources.files import export_csv, read_csv, rejected_values, sampled_schema
from stratiform.sources.tables import (
    RuleViolation,
    align_to_schema,
    create_table,
    delete_where,
    load_csv,
    migrate,
    row_counts,
    rows_with_ids,
    typed_rows,
    update_by_key,
    update_partitions,
    write_checked,
    write_files,
    write_table,
)
from stratiform.specs import ALL_SPECS, RETAIL_ARTICLES, SUGGESTIONS, TRANSACTIONS, TRANSACTIONS_KEYED, TableSpec

HEADER = ",".join(TRANSACTIONS.columns)
LINES = [
    "t1,b1,a1,16-07-2025,2,1.5,0,3.0,s1,Store,North,big,store,c1",
    "t2,b1,a2,17-07-2025,1,2.5,10,2.25,s1,Store,North,big,online,",
]


def csv_file(path, header=HEADER, lines=LINES):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


@pytest.fixture
def database(spark):
    name = "db_" + datetime.now(timezone.utc).strftime("%H%M%S%f")
    spark.sql(f"CREATE DATABASE {name}")
    return name


def test_typed_csv(spark, tmp_path):
    df = read_csv(spark, TRANSACTIONS, csv_file(tmp_path / "t.csv"))
    assert [(r.transaction_date, r.quantity, r.customer_id) for r in df.orderBy("transaction_id").collect()] == [
        (date(2025, 7, 16), 2, "c1"),
        (date(2025, 7, 17), 1, None),
    ]


def test_wrong_header_raises(spark, tmp_path):
    path = csv_file(tmp_path / "t.csv", header=HEADER.replace("basket_id,article_id", "article_id,basket_id"))
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, TRANSACTIONS, path).collect()


def test_rejected_values_are_counted(spark, tmp_path):
    bad = "t3,b1,a2,2025-07-17,many,2.5,10,2.25,s1,Store,North,big,online,"
    path = csv_file(tmp_path / "t.csv", lines=[*LINES, bad])
    counts = {r.column_name: r.rejected_count for r in rejected_values(spark, TRANSACTIONS, path).collect()}
    assert counts == {
        "transaction_date": 1, "quantity": 1, "unit_price": 0, "discount_pct": 0, "total_amount": 0, "_line": 0,
    }


def test_load_reports_and_partitions(spark, tmp_path, database):
    table = f"{database}.transactions"
    report = load_csv(spark, TRANSACTIONS_KEYED, csv_file(tmp_path / "t.csv"), table).first()
    none = dict.fromkeys(["transaction_date", "quantity", "unit_price", "discount_pct", "total_amount", "_line"], 0)
    assert (report.table_name, report.row_count, report.rejects) == (table, 2, none)
    stored = spark.table(table)
    assert {r.date_key for r in stored.collect()} == {20250716, 20250717}
    assert stored.columns[-1] == "date_key" and dict(stored.dtypes)["date_key"] == "bigint"
    load_csv(spark, TRANSACTIONS_KEYED, csv_file(tmp_path / "t.csv"), table)
    assert stored.count() == 2


def test_load_counts_what_it_refuses(spark, tmp_path, database):
    table = f"{database}.transactions"
    more = [
        't3,b1,"a,2",2025-07-17,many,2.5,10,2.25,s1,"Sto""re",North,big,online,',
        "t4,b1,a2,17-07-2025,1,2.5,10",
        "t5,b1,a2,,,,,,s1,Store,North,big,online,c2",
    ]
    report = load_csv(spark, TRANSACTIONS_KEYED, csv_file(tmp_path / "t.csv", lines=[*LINES, *more]), table).first()
    assert report.row_count == 5
    assert {k: v for k, v in report.rejects.items() if v} == {"transaction_date": 1, "quantity": 1, "_line": 1}
    loaded = spark.table(table).select("transaction_id", "article_id", "quantity", "date_key")
    assert rows(loaded) == sorted(
        [("t1", "a1", 2, 20250716), ("t2", "a2", 1, 20250717), ("t3", "a,2", None, None), ("t4", "a2", 1, 20250717), ("t5", "a2", None, None)],
        key=repr,
    )


def test_load_of_some_days_leaves_the_others(spark, tmp_path, database):
    table = f"{database}.transactions"
    load_csv(spark, TRANSACTIONS_KEYED, csv_file(tmp_path / "t.csv"), table)
    again = csv_file(tmp_path / "u.csv", lines=[LINES[1].replace("t2", "t9")])
    report = load_csv(spark, TRANSACTIONS_KEYED, again, table, only_given_partitions=True)
    assert report.first().row_count == 1
    assert rows(spark.table(table).select("transaction_id")) == [("t1",), ("t9",)]


def test_overwrite_keeps_comments(spark, tmp_path, database):
    table = f"{database}.transactions"
    create_table(spark, TRANSACTIONS, table)
    write_table(read_csv(spark, TRANSACTIONS, csv_file(tmp_path / "t.csv")), TRANSACTIONS, table)
    notes = {c.name: c.description for c in spark.catalog.listColumns(table)}
    assert notes["quantity"] == "Units sold"
    assert spark.catalog.getTable(table).description == TRANSACTIONS.comment


def test_only_given_partitions_are_replaced(spark, tmp_path, database):
    table = f"{database}.transactions"
    create_table(spark, TRANSACTIONS_KEYED, table)
    loaded = typed_rows(spark, TRANSACTIONS_KEYED, csv_file(tmp_path / "t.csv"))
    write_table(loaded, TRANSACTIONS_KEYED, table)
    changed = loaded.filter("date_key = 20250717").withColumn("quantity", F.lit(9).cast("bigint"))
    write_table(changed, TRANSACTIONS_KEYED, table, only_given_partitions=True)
    assert rows(spark.table(table).select("transaction_id", "quantity")) == [("t1", 2), ("t2", 9)]
    write_table(changed, TRANSACTIONS_KEYED, table)
    assert spark.table(table).count() == 1


def test_append_rows(spark, database):
    table = f"{database}.ledger"
    create_table(spark, SUGGESTIONS, table)
    one = align_to_schema(spark.createDataFrame([("c1", "pending")], "change_id string, status string"), SUGGESTIONS.schema)
    write_table(one, SUGGESTIONS, table, overwrite=False)
    write_table(one, SUGGESTIONS, table, overwrite=False)
    assert spark.table(table).count() == 2 and spark.table(table).columns == SUGGESTIONS.columns


@pytest.mark.parametrize("spec", ALL_SPECS, ids=lambda s: f"{s.name}-{len(s.columns)}")
def test_every_spec_creates_its_table(spark, database, spec):
    create_table(spark, spec, f"{database}.{spec.name}")
    assert sorted(spark.table(f"{database}.{spec.name}").columns) == sorted(spec.columns)


def test_spec_sizes():
    assert [len(s.columns) for s in ALL_SPECS] == [14, 15, 27, 39, 16, 7]
    assert "article_id" in RETAIL_ARTICLES.required and "valid_to" not in RETAIL_ARTICLES.required


def test_table_at_a_location(spark, tmp_path, database):
    create_table(spark, TRANSACTIONS, f"{database}.placed", str(tmp_path / "placed"))
    write_table(read_csv(spark, TRANSACTIONS, csv_file(tmp_path / "t.csv")), TRANSACTIONS, f"{database}.placed")
    assert spark.read.parquet(str(tmp_path / "placed")).count() == 2


def test_partitioned_files(spark, tmp_path):
    df = spark.range(100).withColumn("p", F.col("id") % 3)
    write_files(df, str(tmp_path / "o"), ["p"], ["id"])
    write_files(df.filter("p = 1").limit(1), str(tmp_path / "o"), ["p"], only_given_partitions=True)
    assert spark.read.parquet(str(tmp_path / "o")).groupBy("p").count().orderBy("p").collect()[1]["count"] == 1


def test_update_by_key(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "id int, v string, w string")
    new = spark.createDataFrame([(1, None), (9, "q")], "id int, v string")
    assert rows(update_by_key(df, new, "id", ["v"])) == [(1, None, "x"), (2, "b", "y"), (None, "c", "z")]
    kept = update_by_key(df, new, "id", ["v"], F.col("w") == "other")
    assert rows(kept) == rows(df)


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    assert rows(delete_where(df, F.col("id") > 1)) == [(1,), (None,)]


def test_migrate_and_align(spark):
    df = spark.createDataFrame([(1, "old")], "id int, old_value string")
    out = migrate(df, {"synced": "boolean", "id": "int"}, ["old_value", "absent"])
    assert out.columns == ["id", "synced"] and dict(out.dtypes)["synced"] == "boolean"
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("id", T.LongType())])
    assert align_to_schema(df, schema).dtypes == [("b", "bigint"), ("id", "bigint")]


def test_rows_with_ids(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(rows_with_ids(df, spark.createDataFrame([(2,), (2,)], "id int"), "id")) == [(2,)]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's, \"fine\"")], "id int, v string")
    export_csv(df, str(tmp_path / "o"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "o"))
    assert back.columns == ["id", "v"] and back.count() == 1


def test_row_counts(spark):
    spark.range(3).createOrReplaceTempView("three")
    spark.range(0).createOrReplaceTempView("none")
    assert rows(row_counts(spark, ["three", "none"])) == [("none", 0), ("three", 3)]


def test_sampled_schema(spark, tmp_path):
    spark.range(5).write.json(str(tmp_path / "j"))
    assert sampled_schema(spark, "json", str(tmp_path / "j"), 1.0).names == ["id"]
    spark.range(5).write.option("header", True).csv(str(tmp_path / "c"))
    assert sampled_schema(spark, "csv", str(tmp_path / "c"), 1.0)["id"].dataType == T.IntegerType()


def test_keyed_update_writes_touched_partitions_only(spark):
    path = work_folder(spark, "update")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("day", T.DateType())])
    data = [(i, "a", date(2025, 1, 1 + i % 4) if i % 5 else None) for i in range(40)]
    write_files(spark.createDataFrame(data, schema), path, ["day"])

    def files():
        table = spark.read.schema(schema).parquet(path)
        return {(r.day, r.f) for r in table.select("day", F.input_file_name().alias("f")).distinct().collect()}

    before = files()
    updates = spark.createDataFrame([(5, "b"), (3, "b"), (7, None), (99, "b")], "id long, v string")
    for _ in range(2):
        update_partitions(spark, path, schema, ["day"], updates, "id", ["v"])
    new = {5: "b", 3: "b", 7: None}
    want = sorted([(i, new.get(i, v), d) for i, v, d in data], key=repr)
    assert rows(spark.read.schema(schema).parquet(path)) == want
    kept = {date(2025, 1, 1), date(2025, 1, 2), date(2025, 1, 3)}
    assert {f for f in before if f[0] in kept} <= files()
    assert not {f for f in before if f[0] not in kept} & files()
    update_partitions(spark, path, schema, ["day"], updates.withColumn("v", F.lit("c")), "id", ["v"], where=F.col("v").isNull())
    assert rows(spark.read.schema(schema).parquet(path).filter("v = 'c'").select("id")) == [(7,)]
    with pytest.raises(ValueError, match="partition"):
        update_partitions(spark, path, schema, ["day"], updates, "id", ["day"])


RULES = (Rule("has_id", "id IS NOT NULL", "fail"), Rule("small", "id < 100", "fail"), Rule("has_v", "v <> ''"))


def test_checked_write_replaces_the_target(spark):
    path = work_folder(spark, "checked") + "/deep/target"
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, v string")
    assert write_checked(df, RULES, path) == {"rows": 3, "has_id": 0, "small": 0, "has_v": 2}
    write_checked(df.withColumn("v", F.lit("b")), RULES, path)
    assert rows(spark.read.parquet(path)) == [(1, "b"), (2, "b"), (3, "b")]


def test_broken_fail_rule_leaves_the_target_alone(spark):
    folder = work_folder(spark, "checked")
    path = f"{folder}/target"
    write_checked(spark.createDataFrame([(1, "a")], "id int, v string"), RULES, path)
    bad = spark.createDataFrame([(None, "x"), (500, "x"), (600, "x"), (7, "x")], "id int, v string")
    with pytest.raises(RuleViolation, match="has_id violated by 1 rows; rule small violated by 3 rows") as raised:
        write_checked(bad, RULES, path)
    assert raised.value.violations == {"has_id": 1, "small": 3}
    assert rows(spark.read.parquet(path)) == [(1, "a")]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    left = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    assert [f.getPath().getName() for f in left] == ["target"]


def test_catalog_inventory(spark, database):
    create_table(spark, SUGGESTIONS, f"{database}.ledger")
    tables = inventory.catalog_tables(spark, [database])
    assert [(r.table_schema, r.table_name, r.comment) for r in tables.collect()] == [
        (database, "ledger", SUGGESTIONS.comment)
    ]
    columns = inventory.catalog_columns(spark, [database]).orderBy("ordinal").collect()
    assert [c.column_name for c in columns] == SUGGESTIONS.columns and columns[0].comment == "Time of submission"


def test_listings_and_allow_list(spark):
    data = [
        ("c1", "s1", "b", "MANAGED", None),
        ("c1", "s1", "a", "VIEW", None),
        ("c1", "s2", "a", "MANAGED", None),
        ("c1", "__internal", "a", "MANAGED", None),
        ("c1", "_own", "a", "MANAGED", None),
        ("c1", "information_schema", "tables", "VIEW", None),
        ("c2", "s3", "a", "MANAGED", None),
        ("c3", "s4", "a", "MANAGED", None),
    ]
    df = spark.createDataFrame(data, inventory.TABLES)
    names = [r.schema_name for r in inventory.list_schemas(df, "c1").collect()]
    assert names == ["_own", "s1", "s2"]
    allowed = inventory.parse_allow_list("c1: s1, s2; c2")
    assert allowed == {"c1": ["s1", "s2"], "c2": []}
    assert [r.schema_name for r in inventory.list_schemas(df, "c1", allowed).collect()] == ["s1", "s2"]
    assert [r.table_name for r in inventory.list_tables(df, "c1", "s1").collect()] == ["a", "b"]
    assert inventory.in_allow_list(df, allowed).count() == 4


def test_exported_lines_are_packed(spark, tmp_path):
    """Lines of a load lie packed in the shared folder and read back as they were."""
    lines = spark.range(2_000).select(F.col("id").cast("string").alias("a"), F.lit('x, "y"').alias("b"))
    spec = TableSpec("t", "", T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))
    path = queries._csv(lines, spec, f"{tmp_path}/in")
    files = list(Path(path).glob("part-*"))
    assert files and all(f.name.endswith(".csv.gz") for f in files) and sum(f.stat().st_size for f in files) < 10_000
    assert read_csv(spark, spec, path).distinct().count() == 2_000


def test_load_leaves_its_table_alone(spark):
    """Neither the shuffles of export and load nor the CSV files lie beside a loaded table, whose files are packed by zstd."""

    def shuffled():
        names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {n for n in names.split() if "shuffle_" in n}

    fields = [T.StructField("a", T.LongType()), T.StructField("day", T.LongType())]
    spec = TableSpec("t", "", T.StructType(fields), partition_by=("day",))
    lines = spark.range(2_000).select(F.col("id").alias("a"), (F.col("id") % 3).alias("day")).repartition(4, "a")
    before = shuffled()
    loaded, report = queries._loaded(spark, spec, lines, "load-test")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    files = [Path(f.removeprefix("file://")) for f in loaded.inputFiles()]
    assert files and all(f.name.endswith(".zstd.parquet") for f in files) and not (files[0].parents[2] / "in").exists()
    assert loaded.distinct().count() == 2_000 and report.first().row_count == 2_000

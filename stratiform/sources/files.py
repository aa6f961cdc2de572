"""Typed file reads (batch and stream) and CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.specs import TableSpec

# A wrong header raises in place of shifting columns: CSV schemas are applied by position.
_CSV = {"header": "true", "enforceSchema": "false"}
_LINE = "_refused_line"
REJECTS = "_rejects"


def read_csv(spark: SparkSession, spec: TableSpec, path: str) -> DataFrame:
    """CSV with a header, read by the declared schema; values that do not parse become NULL."""
    return spark.read.options(dateFormat=spec.date_format, **_CSV).schema(spec.schema).csv(path)


def read_csv_marked(spark: SparkSession, spec: TableSpec, path: str) -> DataFrame:
    """`read_csv` with `_rejects`: names of the columns whose value the declared type refused.

    Spark keeps the line of a row that did not parse; only such lines are taken apart again, as text. A
    line with a wrong number of values and no refused value is marked `_line`.
    """
    schema = T.StructType([*spec.schema.fields, T.StructField(_LINE, T.StringType())])
    rows = spark.read.options(dateFormat=spec.date_format, columnNameOfCorruptRecord=_LINE, **_CSV).schema(schema).csv(path)
    text = ", ".join(f"`{n}` STRING" for n in spec.columns)
    taken = rows.withColumn("_text", F.when(F.col(_LINE).isNotNull(), F.from_csv(_LINE, text)))
    refused = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"_text.`{f.name}`").isNotNull() & F.col(f"`{f.name}`").isNull(), F.lit(f.name))
                for f in typed_fields(spec)
            ]
        )
    )
    marked = F.when(F.col(_LINE).isNull(), F.array().cast("array<string>")).when(F.size(refused) > 0, refused)
    return taken.withColumn(REJECTS, marked.otherwise(F.array(F.lit("_line")))).drop(_LINE, "_text")


def typed_fields(spec: TableSpec) -> list[T.StructField]:
    """Columns whose values can be refused: all but text."""
    return [f for f in spec.schema.fields if not isinstance(f.dataType, T.StringType)]


def reject_counts(names: Sequence[str]) -> list[Column]:
    """Aggregates over `_rejects`, one a column."""
    return [F.count_if(F.array_contains(REJECTS, n)).alias(n) for n in names]


def rejected_values(spark: SparkSession, spec: TableSpec, path: str) -> DataFrame:
    """Rows `column_name, rejected_count`: values present in the CSV that the declared type refuses."""
    names = [*(f.name for f in typed_fields(spec)), "_line"]
    counts = read_csv_marked(spark, spec, path).agg(*reject_counts(names))
    lines = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("rejected_count")) for n in names])
    return counts.select(F.inline(lines))


def sampled_schema(spark: SparkSession, kind: str, path: str, ratio: float = 1.0) -> T.StructType:
    """Schema for a stream, inferred once by a batch read, of all rows unless a share is asked for."""
    options = {"samplingRatio": str(ratio)}
    if kind == "csv":
        options |= {"header": "true", "inferSchema": "true"}
    return spark.read.format(kind).options(**options).load(path).schema


def read_stream(
    spark: SparkSession, kind: str, schema: T.StructType, path: str, **options: str
) -> DataFrame:
    """File stream of CSV (with header), JSON, Parquet or text files."""
    if kind == "csv":
        options = {**_CSV, **options}
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Put a finished folder in the place of another by renaming; the folder it replaces is removed."""
    hadoop, system = _file_system(spark, path)
    target, old = hadoop.Path(path), hadoop.Path(f"{staged}-replaced")
    replaces = system.exists(target)
    if replaces and not system.rename(target, old):
        raise OSError(f"can't move {path} away")
    system.mkdirs(target.getParent())
    if not system.rename(hadoop.Path(staged), target):
        raise OSError(f"can't move {staged} to {path}")
    if replaces:
        system.delete(old, True)


def discard(spark: SparkSession, path: str) -> None:
    hadoop, system = _file_system(spark, path)
    system.delete(hadoop.Path(path), True)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

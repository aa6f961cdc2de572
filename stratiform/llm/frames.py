"""Tables, shared files and small helpers of the operators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.session import work_folder


#: Python workers live longer than a task: large arrays and Arrow batches go back to the system at once.
MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "33554432", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Python workers on this host find the package even if they start in another folder."""
    for variable, value in ({"PYTHONPATH": str(Path(__file__).resolve().parents[2])} | MEMORY).items():
        spark.sparkContext.environment.setdefault(variable, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared folder, as a URI that tasks can open themselves."""
    path = work_folder(spark, label)
    return path if "://" in path or path.startswith("file:") or not spark.sparkContext.getCheckpointDir() else f"{spark.sparkContext.getCheckpointDir()}/{path.rsplit('/', 1)[1]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(key: str, folds: int):
    """crc32 of the key as text, modulo the number of folds, is 0. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    return T.StructField(as_name or name, df.schema[name].dataType, True)

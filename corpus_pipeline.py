"""A corpus pipeline: quality, near duplicates, repeated spans, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
documents of the next. All stages but the last return the columns of documents. Null or empty texts, null keys and
repeated rows are handled as each operator states; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratiform.llm import debruijn, decontaminate, genetic_packing, near_jaccard, quality_fm
from stratiform.llm.frames import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorisation machine rejects."""
    metadata = [c for c in ("n_chars",) if c in docs.columns]
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"), metadata=metadata)
    return quality_fm.keep_good(docs, machine, metadata=metadata)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by five-word shingles of Jaccard similarity 0.8 or more; SimHash
    vantage-point trees and MinHash fingerprints name the candidates."""
    return near_jaccard.keep_first(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words out that lie in a window found earlier; the documents stay."""
    return debruijn.without_repeats(docs, length="n_chars" if "n_chars" in docs.columns else None)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left into sequences."""
    return genetic_packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]
# A trained model, XXH64 and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs

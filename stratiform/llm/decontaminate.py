"""Benchmark decontamination: a broadcast set of normalised test n-grams against every window of every document.

Words are runs of ASCII letters, digits and non-ASCII bytes, with A-Z lowered. A window is `n` consecutive words
of a benchmark item; an item with fewer words, but at least one, is one window of its own length. Hash hits are
verified word by word, so results are exact.

The benchmark is read in blocks of at most `BLOCK` windows, which bounds what is broadcast and what the driver
holds. Each block is one pass of the same stage over the documents, which adds its hits to those of the blocks
before; there is no shuffle, and a row keeps its place, so repeated ids are no concern.

Nulls and edge cases: a null or empty text has no words and is clean; a null benchmark text has no window; a null
item_id takes part in hits but names no item; repeated rows each get the same result; an empty benchmark leaves all
documents clean; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.llm.frames import field
from stratiform.llm.words import LOWER, Words, runs, word_bytes

BLOCK = 500_000
INSIDE = word_bytes("alnum")
HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("item", T.StringType())]))
HITS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", pa.string())]))


def item_windows(text: str | None, n: int) -> Iterator[tuple[bytes, int, int]]:
    """(words joined by a space, hash, number of words) of each window of an item."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    words = Words(data, np.array([0, len(data)]), INSIDE)
    if len(words.start):
        k = min(n, len(words.start))
        for at, h in zip(*words.windows(words.hashes(), k), strict=True):
            yield b" ".join(words.text(i) for i in range(at, at + k)), int(h), k


def blocks(benchmark: DataFrame, item: str, text: str, n: int, limit: int) -> Iterator[dict]:
    """{number of words: {hash: {window: items}}} of at most `limit` windows, item by item."""
    block: dict = {}
    size = 0
    for key, value in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        for window, h, k in item_windows(value, n):
            block.setdefault(k, {}).setdefault(h, {}).setdefault(window, set()).add(key)
            size += 1
            if size >= limit:
                yield block
                block, size = {}, 0
    yield block


def find(data: np.ndarray, offsets: np.ndarray, block: dict, tables: dict) -> tuple[Words, list[tuple]]:
    """Words of a run of rows and its verified hits: (row, first word in the row, last word + 1, items)."""
    words = Words(LOWER[data], offsets, INSIDE)
    hashes = words.hashes()
    hits = []
    for k, known in block.items():
        at, h = words.windows(hashes, k)
        sure = tables[k]
        place = np.searchsorted(sure, h)
        place[place == len(sure)] = 0
        for i, x in zip(at[sure[place] == h], h[sure[place] == h], strict=True):
            items = known[int(x)].get(b" ".join(words.text(j) for j in range(i, i + k)))
            if items:
                row = words.row[i]
                hits.append((row, i - words.first[row], i - words.first[row] + k, items))
    return words, hits


def scan(docs: DataFrame, text: str, block: dict, hits_name: str) -> DataFrame:
    """Adds the block's hits to those in `hits_name`; all other columns pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        tables = {k: np.sort(np.fromiter(known, np.uint64, len(known))) for k, known in block.items()}
        for batch in batches:
            place = batch.schema.get_field_index(hits_name)
            found = batch.column(place).to_pylist()
            for low, _, data, offsets in runs(batch.column(batch.schema.get_field_index(text))):
                for row, start, end, items in find(data, offsets, block, tables)[1]:
                    found[low + row] = [*(found[low + row] or ()), *({"start": int(start), "end": int(end), "item": x} for x in items)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(found, HITS_ARROW))

    return docs.mapInArrow(run, docs.schema)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str, item: str, bench_text: str, n: int, limit: int, hits_name: str) -> DataFrame:
    docs = docs.withColumn(hits_name, F.lit(None).cast(HITS))
    for block in blocks(benchmark, item, bench_text, n, limit):
        docs = scan(docs, text, block, hits_name)
    return docs


def covered(hits: list | None, n: int) -> np.ndarray:
    """Which of the n words lie in a hit."""
    edge = np.zeros(n + 1, np.int64)
    for hit in hits or ():
        edge[hit["start"]] += 1
        edge[hit["end"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", bench_text: str = "text", n: int = 10, limit: int = BLOCK) -> DataFrame:
    """One row a document: key, n_words, n_hit (words inside a hit), items (distinct, sorted as text), hits (word spans)."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hit = with_hits(slim, benchmark, "text", item, bench_text, n, limit, "hits")
    schema = T.StructType([field(docs, key), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            n_words = [x for _, _, data, offsets in runs(batch.column(1)) for x in Words(data, offsets, INSIDE).n.tolist()]
            n_hit = [int(covered(h, k).sum()) if h else 0 for h, k in zip(found, n_words, strict=True)]
            items = [sorted({x["item"] for x in h or () if x["item"] is not None}) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), batch.column(2)], names=schema.names)

    return hit.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", bench_text: str = "text", n: int = 10, mode: str = "documents", limit: int = BLOCK) -> DataFrame:
    """The documents without contamination, with their own columns. `documents` drops a document with a hit;
    `spans` keeps it without the bytes from the first to the last word of each run of hit words."""
    name = "_hits"
    while name in docs.columns:
        name += "_"
    hit = with_hits(docs, benchmark, text, item, bench_text, n, limit, name)
    if mode == "documents":
        return hit.filter(F.col(name).isNull()).drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, texts = batch.schema.get_field_index(name), batch.schema.get_field_index(text)
            values = batch.column(texts).to_pylist()
            for i, hits in enumerate(batch.column(place).to_pylist()):
                if hits:
                    data = np.frombuffer(values[i].encode(), np.uint8)
                    words = Words(data, np.array([0, len(data)]), INSIDE)
                    out = np.zeros(len(data) + 1, np.int64)
                    mask = np.r_[False, covered(hits, len(words.start)), False]
                    first, last = np.flatnonzero(mask[1:] & ~mask[:-1]), np.flatnonzero(mask[:-1] & ~mask[1:]) - 1
                    out[words.start[first]] += 1
                    out[words.end[last]] -= 1
                    values[i] = data[np.cumsum(out[:-1]) == 0].tobytes().decode()
            yield batch.set_column(texts, batch.schema.field(texts), pa.array(values, batch.schema.field(texts).type))

    return hit.mapInArrow(run, hit.schema).drop(name)


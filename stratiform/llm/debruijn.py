"""Substring dedup over a De Bruijn graph of token k-mers, by source coordinates.

An edge is a window of `k` consecutive words; its source is the document with the smallest key that has it. A window is
repeated if its source is another document, or if it starts earlier in its own. Steps:

1. Anchors. Every window holds `k - GRAM + 1` word grams; the one with the smallest hash is its anchor, so equal windows
   have equal anchors, and a document has about one anchor for seven windows. Anchors that occur once rule their windows
   out, which is most of them.
2. Whole copies. Documents with equal word sequences are one path; all but the first are removed whole.
3. Edges. Windows of the anchors left meet by a 96-bit hash; each learns its source and how often the edge occurs.
4. Paths. Along a document, an edge goes on the path of the edge before it if both have one source and one number of
   occurrences, that is where the node between them doesn't branch; paths are joined back to the texts as word spans.

Hot anchors and edges: a task settles what repeats within its batch and ships one row for it, so a window that a third of
all documents share meets as one row a batch. Nothing is capped, and nothing is broadcast or collected.

Words are compared by hashes of 64 (anchors, which only choose candidates) and 96 bits (edges). Keys are integers.

Nulls and edge cases: a null or empty text has no words; a text of fewer than k words has no window; a null key's
document is judged against itself only; rows with one key are one document, each judged against others and itself;
an empty table gives an empty result; other columns pass by, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.llm.frames import field, stored
from stratiform.llm.words import POLY2, Words, as_long, mix, runs, word_bytes

K = 20
GRAM = 8
INSIDE = word_bytes("space")
SPANS = "array<struct<start:bigint,end:bigint>>"


def anchors_of(words: Words, hashes: np.ndarray, k: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, first word of its anchor, hash of the anchor)."""
    at, h = words.windows(hashes, gram)
    by_word = np.zeros(len(hashes) + 1, np.uint64)
    by_word[at] = h
    start = np.flatnonzero(words.row[: len(hashes) - k + 1] == words.row[k - 1 :]) if len(hashes) >= k else np.zeros(0, np.int64)
    if not len(start):
        return start, start, h[:0]
    low = sliding_window_view(by_word, k - gram + 1)[start].argmin(axis=1) + start
    return start, low, by_word[low]


def first_in_batch(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which rows have the smallest key of their hash; one or more for each hash."""
    _, place = np.unique(hashes, return_inverse=True)
    least = np.full(place.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, place, keys)
    return keys == least[place]


def apart(keys: np.ndarray, places: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of their own for rows that need not meet others."""
    return mix(mix(keys.view(np.uint64) + np.uint64(salt)) ^ places.astype(np.uint64))


def anchor_rows(docs: DataFrame, k: int, gram: int) -> DataFrame:
    """(g, key, pos, sure): anchors to be counted by g; `sure` ones are known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            ids = batch.column(0).to_numpy()
            for low, _, data, offsets in runs(batch.column(1)):
                words = Words(data, offsets, INSIDE)
                _, at, _ = anchors_of(words, hashes := words.hashes(), k, gram)
                at = np.unique(at)
                row = words.row[at]
                grams, h = words.windows(hashes, gram)
                found.append((h[np.searchsorted(grams, at)], ids[low + row], at - words.first[row]))
            if not found:
                continue
            h, keys, pos = (np.concatenate(x) for x in zip(*found, strict=True))
            _, place, count = np.unique(h, return_inverse=True, return_counts=True)
            many = count[place] > 1
            first = np.zeros(len(h), bool)
            first[np.unique(place, return_index=True)[1]] = True
            g = np.where(many & ~first, apart(keys, pos, 1), h)
            for x in range(0, len(g), 50_000):
                y = slice(x, x + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(g[y])), pa.array(keys[y]), pa.array(pos[y].astype(np.int32)), pa.array(many[y])], names=["g", "key", "pos", "sure"])

    return docs.mapInArrow(run, "g bigint, key bigint, pos int, sure boolean")


def edge_rows(docs: DataFrame, names: tuple[str, str, str], k: int, gram: int) -> DataFrame:
    """(g, g2, key, start, sure) of the windows of anchors; `names` are the columns of key, text and the anchors' places;
    `sure` windows have an earlier document in the batch."""
    columns = [docs.columns.index(x) for x in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            keys, text, places = (batch.column(i) for i in columns)
            ids = keys.to_numpy()
            for low, high, data, offsets in runs(text):
                words = Words(data, offsets, INSIDE)
                start, at, _ = anchors_of(words, hashes := words.hashes(), k, gram)
                part = places.slice(low, high - low)
                wanted = np.zeros(len(hashes) + 1, bool)
                wanted[part.flatten().to_numpy() + np.repeat(words.first[:-1], part.value_lengths().to_numpy())] = True
                start = start[wanted[at]]
                windows, h = words.windows(hashes, k)
                h = h[np.searchsorted(windows, start)]
                h2 = words.windows(words.hashes(POLY2), k, POLY2)[1][np.searchsorted(windows, start)]
                row = words.row[start]
                # of the windows that repeat within a document only the first needs to meet others
                once = np.unique(np.stack([row.astype(np.uint64), h, h2]), axis=1, return_index=True)[1] if len(h) else np.zeros(0, np.int64)
                found.append((h[once], h2[once].astype(np.uint32).view(np.int32), ids[low + row[once]], (start - words.first[row])[once]))
            if not found:
                continue
            h, h2, keys, at = (np.concatenate(x) for x in zip(*found, strict=True))
            sure = ~first_in_batch(h ^ (h2.view(np.uint32).astype(np.uint64) << np.uint64(32)), keys)
            g = np.where(sure, apart(keys, at, 2), h)
            for x in range(0, len(g), 50_000):
                y = slice(x, x + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(g[y])), pa.array(h2[y]), pa.array(keys[y]), pa.array(at[y].astype(np.int32)), pa.array(sure[y])], names=["g", "g2", "key", "start", "sure"])

    return docs.mapInArrow(run, "g bigint, g2 int, key bigint, start int, sure boolean")


def sequences(docs: DataFrame) -> DataFrame:
    """(key, n_words, digest of the words) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in runs(batch.column(1)):
                words = Words(data, offsets, INSIDE)
                joined, begin, end = words.joined()
                digests = [hashlib.sha256(joined[begin[a] : end[b - 1]] if b > a else b"").digest() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(words.n), pa.array(digests, pa.binary())], names=["key", "n_words", "digest"])

    return docs.mapInArrow(run, "key bigint, n_words bigint, digest binary")


def paths(edges: DataFrame) -> DataFrame:
    """(key, start, end, source, n): spans of words on one path, from the edges of each document that repeat another's."""
    order = Window.partitionBy("key").orderBy("start")
    goes_on = (F.col("start") == F.lag("start").over(order) + 1) & F.col("source").eqNullSafe(F.lag("source").over(order)) & F.col("n").eqNullSafe(F.lag("n").over(order))
    heads = edges.withColumn("head", F.when(goes_on, 0).otherwise(1))
    numbered = heads.withColumn("path", F.sum("head").over(order))
    return numbered.groupBy("key", "path").agg(F.min("start").cast("bigint").alias("start"), F.max("start").cast("bigint").alias("last"), F.first("source").alias("source"), F.first("n").alias("n")).drop("path")


def repeated_spans(keyed: DataFrame, key: str, text: str, spans_name: str, k: int = K, gram: int = GRAM) -> DataFrame:
    """(key, spans), by these names, of the words that lie in a window with an earlier document as its source; documents with
    such only. Keys are integers and not null."""
    slim = keyed.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marks = stored(sequences(slim), "sequences")
    firsts = marks.groupBy("digest", "n_words").agg(F.min("key").alias("source"), F.max("key").alias("last")).filter("last > source")
    firsts = stored(firsts, "firsts")  # as a table, so that a join with a busy digest can be split
    copies = marks.filter(F.col("n_words") >= k).join(firsts.drop("last"), ["digest", "n_words"]).filter("key > source").select("key", "n_words").distinct()
    copies = stored(copies, "copies")
    counted = anchor_rows(slim, k, gram).withColumn("n", F.count("*").over(Window.partitionBy("g"))).filter("sure OR n > 1")
    places = counted.join(copies.select("key"), "key", "left_anti").groupBy("key").agg(F.collect_set("pos").alias("places"))
    # merged at every size: a table small enough to be broadcast today grows with the corpus. All columns go along, so
    # that this shuffle of the documents is the one that their spans are joined to
    marked = keyed.join(places.select(F.col("key").alias(key), F.col("places").alias(spans_name)).hint("merge"), key)
    edges = edge_rows(marked, (key, text, spans_name), k, gram)
    meeting = Window.partitionBy("g", "g2")
    judged = edges.withColumn("source", F.min("key").over(meeting)).withColumn("n", F.count("*").over(meeting)).filter("sure OR key > source")
    # what its batch settled has no source of its own here; such edges make paths of their own
    judged = judged.select("key", "start", F.when(~F.col("sure"), F.col("source")).alias("source"), F.when(~F.col("sure"), F.col("n")).alias("n"))
    spans = paths(judged).select("key", F.struct("start", (F.col("last") + k).alias("end")).alias("span"))
    spans = spans.groupBy("key").agg(F.collect_list("span").alias("spans"))
    whole = copies.select("key", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end"))).alias("spans"))
    return spans.unionByName(whole).select(F.col("key").alias(key), F.col("spans").alias(spans_name))


def kept_words(data: np.ndarray, offsets: np.ndarray, spans: list, k: int) -> tuple[Words, np.ndarray]:
    """Words of a run and which of them stay: not in a span, nor in a window that starts earlier in its own document."""
    words = Words(data, offsets, INSIDE)
    edge = np.zeros(len(words.start) + 1, np.int64)
    for row, found in enumerate(spans):
        for x in found or ():
            edge[words.first[row] + x["start"]] += 1
            edge[words.first[row] + x["end"]] -= 1
    at, h = words.windows(words.hashes(), k)
    if len(at):
        _, h2 = words.windows(words.hashes(POLY2), k, POLY2)
        order = np.lexsort((at, h2, h, words.row[at]))
        a, b = order[1:], order[:-1]
        later = a[(h[a] == h[b]) & (h2[a] == h2[b]) & (words.row[at[a]] == words.row[at[b]])]
        np.add.at(edge, at[later], 1)
        np.add.at(edge, at[later] + k, -1)
    return words, np.cumsum(edge[:-1]) == 0


def with_spans(docs: DataFrame, key: str, text: str, k: int, gram: int, names: tuple[str, str]) -> DataFrame:
    """The documents with their spans by the second name. Their texts are shuffled by key once, for the anchors' places and
    for the spans: Spark uses an exchange again that has the same rows, columns and keys. Null keys are not shuffled."""
    long = F.col(key).cast("bigint")
    keyed = docs.withColumn(names[0], long).filter(F.col(names[0]).isNotNull())
    spans = repeated_spans(keyed, names[0], text, names[1], k, gram)
    joined = keyed.join(spans.hint("merge"), names[0], "left").select(*docs.columns, names[1])
    return joined.unionByName(docs.filter(long.isNull()).withColumn(names[1], F.lit(None).cast(SPANS)))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, gram: int = GRAM) -> DataFrame:
    """One row a document: key, n_words, n_removed, kept_text (the words that stay, joined by one space)."""
    slim = docs.select(F.col(key), F.col(text).alias("t"))
    joined = with_spans(slim.withColumnRenamed(key, "id"), "id", "t", k, gram, ("key", "spans"))
    schema = T.StructType([field(docs, key), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in runs(batch.column(1)):
                words, stay = kept_words(data, offsets, batch.column(2).slice(low, high - low).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(words.n), pa.array(words.per_row(~stay)), pa.array(kept_texts(words, stay), pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)


def kept_texts(words: Words, stay: np.ndarray) -> list[bytes]:
    joined, begin, end = words.joined()
    begin, end = begin.tolist(), end.tolist()
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        # runs of words that stay are slices of the joined words
        flag = np.r_[False, stay[a:b], False]
        first, last = np.flatnonzero(flag[1:] & ~flag[:-1]) + a, np.flatnonzero(flag[:-1] & ~flag[1:]) + a - 1
        out.append(b" ".join(joined[begin[x] : end[y]] for x, y in zip(first.tolist(), last.tolist(), strict=True)))
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, gram: int = GRAM, length: str | None = None) -> DataFrame:
    """The documents with repeated words cut out of their texts, with their own columns; a text without repeats stays as
    it is. `length` names a column that gets the new number of characters."""
    names = ("_key", "_spans")
    while set(names) & set(docs.columns):
        names = tuple(f"{x}_" for x in names)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(place).to_pylist()
            for low, high, data, offsets in runs(batch.column(place)):
                words, stay = kept_words(data, offsets, batch.column(batch.num_columns - 1).slice(low, high - low).to_pylist(), k)
                if not stay.all():
                    removed, texts = words.per_row(~stay), kept_texts(words, stay)
                    for row in np.flatnonzero(removed).tolist():
                        values[low + row] = texts[row].decode()
            yield batch.set_column(place, batch.schema.field(place), pa.array(values, batch.schema.field(place).type)).select(range(batch.num_columns - 1))

    out = with_spans(docs, key, text, k, gram, names).mapInArrow(run, docs.schema)
    return out if length is None else out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))

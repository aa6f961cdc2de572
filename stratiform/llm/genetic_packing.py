"""Best-fit packing by a grouping genetic algorithm on islands.

A document is its subword ids and an end id; one longer than a sequence is cut into pieces of full length and a rest.
Pieces are dealt by hash into shards of about `SHARD` pieces, so a shard keeps its size as data grows. A shard is packed
on `ISLANDS` islands: each evolves a population of packings, whose crossover injects whole well-filled bins of one parent
into the other, dissolves the bins that hold one of these pieces too, and puts displaced pieces back by best fit. After
each epoch an island sends its best packing to the next island of its shard; the best of all is the result.

A shard is one row of lengths, an island's packings a few rows of bin numbers; texts and ids never leave the task that
tokenizes them. Parts of words are tokenized once for each run of rows and kept in a bounded cache of the worker, which
changes no result: no token of this tokenizer crosses white space.

Nulls and edge cases: a null or empty text is its end id alone; a null key is a document like any other; rows that repeat
a key are packed each; a piece of full length is a sequence of its own; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stratiform.llm.frames import field, stored
from stratiform.llm.words import LOWER, POLY, Known, Words, joined, letters, runs, word_bytes

CAPACITY = 4096
END = 1
SHARD = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 6, 4
CACHE = 1 << 20
RUN = 1 << 20
GROUP = 400
WORD_END, CLOSING = "</w>", b".,;:!?"
INSIDE = word_bytes("space")
IS_CLOSING = np.isin(np.arange(256), list(CLOSING))


class WordTokenizer:
    """Ids of words, each part of a word tokenized by the library once while it stays in the cache.

    Letters with closing marks after them are two parts, which the tokenizer never joins; letters are told apart in lower
    case, which the tokenizer makes of them anyway. Parts of letters alone are tokenized many to a call, and the ids that
    end a word show where each stops.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(CACHE)  # by a part's 64-bit hash, as runs tell words apart by it too
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts, where those of each part begin, and how many they are; `plain` parts are letters alone."""
        begin, size, out, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], 0
        many, others = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        text, at = joined(data, start[many], end[many])
        groups = [many[i : i + GROUP] for i in range(0, len(many), GROUP)]
        cut = [*at[:-1:GROUP].tolist(), len(text)]
        # a call at a time, as the library's results are large
        found = (self.encode([text[a + 1 : b].decode()])[0] for a, b in pairwise(cut))
        for group, ids in zip(groups, found, strict=True):
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(group) or stop[-1] != len(ids):
                others.append(group)
                continue
            size[group] = np.diff(stop, prepend=0)
            begin[group] = n + stop - size[group]
            out.append(ids)
            n += len(ids)
        rest = np.concatenate(others)
        for low in range(0, len(rest), 1000):
            some = rest[low : low + 1000]
            found = self.encode([data[a:b].tobytes().decode() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
            size[some] = [len(x) for x in found]
            begin[some] = n + np.cumsum(size[some]) - size[some]
            out += found
            n += int(size[some].sum())
        return np.concatenate([np.zeros(0, "<u4"), *out]), begin, size

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a run, and the number of ids of each row."""
        data, start, end = words.data, words.start, words.end
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(words.n), np.int64)
        # where the closing marks of a word begin
        small = np.int32 if len(data) < 2**31 else np.int64
        last = np.where(IS_CLOSING[data], small(-1), np.arange(len(data), dtype=small))
        np.maximum.accumulate(last, out=last)
        core = np.maximum(last[end - 1] + 1, start)
        odd = np.zeros(len(data) + 1, small)
        np.cumsum(~letters(data), out=odd[1:])
        plain = (odd[core] == odd[start]) & (core > start)
        core = np.where(plain, core, end)
        # other words keep their case
        kept = np.zeros(len(data) + 1, np.int8)
        kept[start[~plain]] = 1
        kept[end[~plain]] -= 1
        data = np.where(np.cumsum(kept[:-1], dtype=np.int8), data, LOWER[data])
        parts = 1 + (core < end)
        first = np.cumsum(parts) - parts
        a, b, plain = np.repeat(start, parts), np.repeat(core, parts), np.repeat(plain, parts)
        mark = first[parts == 2] + 1
        a[mark], b[mark], plain[mark] = core[parts == 2], end[parts == 2], False
        flat, own = self.known.ids(POLY.spans(data, a, b), lambda at: self.learn(data, a[at], b[at], plain[at]))
        return flat, words.per_row(np.add.reduceat(own, first))


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker, so words met in one task are known in the next."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32."""
    schema = T.StructType([field(docs, key), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = word_tokenizer(tokenizer)
        for batch in batches:
            for low, _, data, offsets in runs(batch.column(1), RUN):
                flat, n = tokenize.ids(Words(data, offsets, INSIDE))
                out, at = [], 0
                for row, size in enumerate(n.tolist()):
                    ids = np.append(flat[at : at + size], np.uint32(end)).astype("<u4")
                    at += size
                    for p, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        out.append((low + row, p, start, len(part), zlib.crc32(part.tobytes())))
                rows, p, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(p, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select(F.col(key), F.col(text).alias("t")).mapInArrow(run, schema)


def best_fit(sizes: list[int], items: list[int], bins: dict[int, list[int]], room: dict[int, int], capacity: int) -> None:
    """Puts the items, in their order, each into the fullest bin with room for it."""
    free = sorted((r, b) for b, r in room.items() if r)
    fresh = max(bins, default=-1) + 1
    for item in items:
        size = sizes[item]
        place = bisect_left(free, (size, -1))
        if place < len(free):
            left, b = free.pop(place)
        else:
            left, b, fresh = capacity, fresh, fresh + 1
            bins[b] = []
        bins[b].append(item)
        room[b] = left - size
        if room[b]:
            insort(free, (room[b], b))


class Packing:
    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.bins = bins
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        #: fewer bins first, then fuller ones
        self.worth = (-len(bins), sum(f * f for f in self.fill) / capacity**2)

    def numbers(self, n: int) -> list[int]:
        out = [0] * n
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def from_numbers(numbers: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for item, b in enumerate(numbers):
        bins.setdefault(b, []).append(item)
    return list(bins.values())


def pack_again(sizes: list[int], kept: list[list[int]], displaced: list[int], capacity: int) -> Packing:
    bins = dict(enumerate(kept))
    room = {b: capacity - sum(sizes[i] for i in items) for b, items in bins.items()}
    best_fit(sizes, sorted(displaced, key=lambda i: -sizes[i]), bins, room, capacity)
    return Packing(sizes, list(bins.values()), capacity)


def crossover(sizes: list[int], a: Packing, b: Packing, rng: np.random.Generator, capacity: int) -> Packing:
    """Whole bins of `a`, fuller ones more often, into `b`."""
    chance = (np.array(a.fill) / capacity) ** 4 * 0.5
    injected = [items for items, hit in zip(a.bins, rng.random(len(a.bins)) < chance, strict=True) if hit]
    there = {i for items in injected for i in items}
    kept = [items for items in b.bins if there.isdisjoint(items)]
    held = there.union(*kept)
    return pack_again(sizes, injected + kept, [i for i in range(len(sizes)) if i not in held], capacity)


def mutate(sizes: list[int], p: Packing, rng: np.random.Generator, capacity: int) -> Packing:
    """Dissolves the emptiest bins and a few others."""
    order = np.argsort(p.fill)
    gone = {*order[:2].tolist(), *rng.integers(0, len(p.bins), 2 + len(p.bins) // 20).tolist()}
    return pack_again(sizes, [x for i, x in enumerate(p.bins) if i not in gone], [x for i in gone for x in p.bins[i]], capacity)


def evolve(sizes: list[int], known: list[list[int]], seed: int, capacity: int) -> list[int]:
    """Bin numbers of the best packing after some generations, from the packings known so far."""
    rng = np.random.default_rng(seed)
    herd = [Packing(sizes, from_numbers(x), capacity) for x in known]
    least = math.ceil(sum(sizes) / capacity)
    while len(herd) < POPULATION:
        # decreasing order, blurred but for the first
        blur = rng.random(len(sizes)) * (0 if not herd else 0.1 * capacity)
        bins: dict[int, list[int]] = {}
        best_fit(sizes, np.argsort(-(np.array(sizes) + blur), kind="stable").tolist(), bins, {}, capacity)
        herd.append(Packing(sizes, list(bins.values()), capacity))
    herd.sort(key=lambda p: p.worth, reverse=True)
    for _ in range(GENERATIONS):
        if len(herd[0].bins) == least:
            break
        children = []
        for _ in range(POPULATION // 2):
            a, b = rng.choice(len(herd), 2, replace=False)
            children.append(crossover(sizes, herd[a], herd[b], rng, capacity))
        children.append(mutate(sizes, herd[0], rng, capacity))
        herd = sorted(herd + children, key=lambda p: p.worth, reverse=True)[:POPULATION]
    return herd[0].numbers(len(sizes))


def epoch(state: DataFrame, number: int, capacity: int, tasks: int) -> DataFrame:
    """(shard, island, sizes, known) to the same with the best packing of each island alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                best = evolve(x["sizes"], x["known"], hash((x["shard"], x["island"], number)) & 0x7FFFFFFF, capacity)
                yield pa.RecordBatch.from_arrays([pa.array([x["shard"]]), pa.array([x["island"]], pa.int32()), pa.array([x["sizes"]], pa.list_(pa.int32())), pa.array([[best]], pa.list_(pa.list_(pa.int32())))], names=["shard", "island", "sizes", "known"])

    return stored(state.repartition(tasks, "shard", "island").mapInArrow(run, "shard bigint, island int, sizes array<int>, known array<array<int>>"), f"epoch{number}")


def pack(rows: DataFrame, length: str = "length", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The rows, each at most `capacity` long, with sequence_id and offset; `rows` is read more than once, so store it."""
    columns = rows.columns
    shards = max(1, math.ceil(rows.count() / shard))
    dealt = rows.select(F.struct(*columns).alias("row"), F.pmod(F.xxhash64(*columns), F.lit(shards)).alias("shard"))
    grouped = dealt.groupBy("shard").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    grouped = stored(grouped, "shards")
    islands = grouped.select("shard", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island"), F.transform("rows", lambda r: r[length].cast("int")).alias("sizes"), F.array().cast("array<array<int>>").alias("known"))
    state = epoch(islands, 0, capacity, shards * ISLANDS)
    for number in range(1, EPOCHS):
        elite = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("known").alias("guest"))
        state = epoch(state.join(elite, ["shard", "island"]).select("shard", "island", "sizes", F.concat("known", "guest").alias("known")), number, capacity, shards * ISLANDS)
    packing = state.select("shard", F.struct((F.array_max(F.col("known")[0]) + 1).alias("bins"), "island", F.col("known")[0].alias("bin")).alias("p"))
    best = packing.groupBy("shard").agg(F.min("p").alias("p")).select("shard", F.col("p.bin").alias("bin"))
    item = grouped.join(best, "shard").select("shard", F.inline(F.arrays_zip("rows", "bin")))
    placed = item.select("rows.*", F.col("shard").alias("_s"), F.col("bin").alias("_b"))
    sequence = F.shiftleft(F.col("_s").cast("bigint"), 32) + F.col("_b")
    return placed.withColumn("sequence_id", sequence).drop("_s", "_b")


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset (its place in the sequence)."""
    cut = stored(pieces(docs, tokenizer, key, text, capacity, end), "pieces")
    order = Window.partitionBy("sequence_id").orderBy(key, "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pack(cut, capacity=capacity).withColumn("offset", F.sum("length").over(order) - F.col("length"))

"""SimHash near duplicates: exact pairs within a Hamming distance through vantage-point trees.

A fingerprint has a bit where more than half of the XXH64 hashes of a document's word shingles have it. Equal
fingerprints are merged first, so copies never meet each other. Links at `radius` or fewer bits are found in two
layers of vantage-point trees:

* across tasks: bits are cut into `BLOCKS` blocks; two fingerprints within `radius` differ in one block by at most
  radius // BLOCKS, and the Hamming distance of a block is a metric. Each block has a tree of fixed random vantage
  points; a node sends what is within the middle distance one way and the rest the other. A fingerprint lives in one
  shard a tree and also visits each shard that its triangle bound reaches beyond a boundary. The depth follows from
  the number of fingerprints, so shards keep their size as data grows;
* in a shard: a tree over the full distance with the members' own vantage points, pruned by the same bound.

A shard gives links that connect what is linked, not all pairs: a star a local component. Nothing but counts reaches
the driver. A shard's task holds 9 bytes a distinct fingerprint that lives in or visits it.

Nulls and edge cases: a null or empty text has fingerprint 0 and links like any other; a text of fewer words than a
shingle is one shingle; a null key gets a fingerprint and a null component and links nothing; rows with one key are
one document; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.llm.components import components
from stratiform.llm.frames import field, stored
from stratiform.llm.words import LOWER, Words, as_long, mix, runs, word_bytes

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 3
SHARD = 2048
LEAF = 64
RUN = 1 << 19
INSIDE = word_bytes("space")


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle; a row of fewer than k words, but one at least, is one shingle."""
    joined, place, stop = words.joined()
    many = np.maximum(words.n - k + 1, np.minimum(words.n, 1))
    row = np.repeat(np.arange(len(many)), many)
    first = words.first[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
    last = np.minimum(first + k, words.first[row + 1]) - 1
    digest = xxhash.xxh64_intdigest
    begin, end = place[first].tolist(), stop[last].tolist()
    return row, np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)], np.uint64)


def majority(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """The fingerprint of each row; 0 without a hash."""
    out = np.zeros(rows, np.uint64)
    if len(row):
        used, first, n = np.unique(row, return_index=True, return_counts=True)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out[used] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row a document: key and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in runs(batch.column(1), RUN):
                words = Words(LOWER[data], offsets, INSIDE)
                fp = as_long(majority(*shingle_hashes(words, shingle), high - low))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(fp)], names=[key, "fp"])

    slim = docs.select(F.col(key), F.col(text).alias("t"))
    return slim.mapInArrow(run, T.StructType([field(docs, key), T.StructField("fp", T.LongType())]))


def block_bits(block: int, blocks: int = BLOCKS) -> tuple[int, int]:
    """First bit and number of bits of a block."""
    return 64 * block // blocks, 64 * (block + 1) // blocks - 64 * block // blocks


def routes(fp: np.ndarray, depth: int, radius: int, blocks: int = BLOCKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, place in fp, lives there) for every shard that a fingerprint lives in or visits, block by block."""
    for block in range(blocks):
        low, width = block_bits(block, blocks)
        bits = (fp >> np.uint64(low)) & np.uint64(2**width - 1)
        reach, middle = radius // blocks, width // 2
        at, node, home = np.arange(len(fp)), np.full(len(fp), 1, np.int64), np.ones(len(fp), bool)
        for _ in range(depth):
            vantage = mix(node.astype(np.uint64) * np.uint64(blocks) + np.uint64(block + 1)) & np.uint64(2**width - 1)
            far = np.bitwise_count(bits[at] ^ vantage).astype(np.int64)
            inner, outer = far - reach <= middle, far + reach > middle
            at, home = np.r_[at[inner], at[outer]], np.r_[home[inner] & (far[inner] <= middle), home[outer] & (far[outer] > middle)]
            node = np.r_[node[inner] * 2, node[outer] * 2 + 1]
        yield node * blocks + block, at, home


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the sets of a[i] and b[i]; a label points to the smallest place of its set."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label[:] = label[label]


def link_shard(fp: np.ndarray, home: np.ndarray, radius: int, leaf: int = LEAF) -> np.ndarray:
    """Labels of the local components: every fingerprint against the members within the radius."""
    label = np.arange(len(fp))
    stack = [(np.flatnonzero(home), np.arange(len(fp)))]
    while stack:
        members, asking = stack.pop()
        if not len(members) or not len(asking):
            continue
        split = False
        if len(members) > leaf:
            vantage = fp[members[len(members) // 2]]
            own = np.bitwise_count(fp[members] ^ vantage).astype(np.int64)
            middle = int(np.median(own))
            middle = middle if (own > middle).any() else middle - 1
            split = bool((own <= middle).any())
        if split:
            far = np.bitwise_count(fp[asking] ^ vantage).astype(np.int64)
            stack += [(members[own <= middle], asking[far - radius <= middle]), (members[own > middle], asking[far + radius > middle])]
            continue
        step = max(1, (1 << 20) // len(members))
        for at in range(0, len(asking), step):
            q = asking[at : at + step]
            x, y = np.nonzero(np.bitwise_count(fp[q][:, None] ^ fp[members][None, :]) <= radius)
            join_labels(label, q[x], members[y])
    return label


def links(distinct: DataFrame, n: int, radius: int = RADIUS, shard: int = SHARD, blocks: int = BLOCKS) -> DataFrame:
    """(fp, other) that connect all distinct fingerprints within the radius; n is their number."""
    depth = max(0, math.ceil(math.log2(max(n, 1) / shard)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for low in range(0, len(values), 20_000):
                part = values[low : low + 20_000]
                for node, at, home in routes(part.view(np.uint64), depth, radius, blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(part[at]), pa.array(home)], names=["shard", "fp", "home"])

    def connect(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        label = link_shard(fp, group.column("home").to_numpy(), radius)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"fp": as_long(fp[moved]), "other": as_long(fp[label[moved]])})

    dealt = distinct.select("fp").mapInArrow(deal, "shard bigint, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInArrow(connect, "fp bigint, other bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row a document: key, fp, component_id (the smallest key linked with it over any number of links)."""
    marks = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = stored(marks.filter(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("rep")), "distinct")
    found = stored(links(distinct, distinct.count(), radius), "pairs")
    reps = distinct.select(F.col("fp").alias("other"), F.col("rep").alias("b"))
    ends = found.join(distinct, "fp").join(reps, "other").select(F.col("rep").alias("a"), "b")
    roots = components(ends)
    named = distinct.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return marks.join(named, "fp", "left").select(key, "fp", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def hex16(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest key stays, with its own columns.
    Rows with a null key stay; of rows that share a key one stays."""
    firsts = near_duplicates(docs, key, text, shingle, radius).filter(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = docs.join(firsts, key, "left_semi")
    repeats = docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1")
    if not repeats.isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.select(docs.columns).unionByName(docs.filter(F.col(key).isNull()))

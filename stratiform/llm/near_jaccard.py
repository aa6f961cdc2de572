"""Near duplicates of word shingles: candidates from SimHash vantage-point trees and from several MinHash fingerprints, each
link verified by Jaccard similarity.

A document is the set of its shingles' 64-bit hashes. Equal sets are merged first. Two sources name candidates:

* SimHash fingerprints of the same shingles within `RADIUS` bits, found by the vantage-point trees of `simhash_vp`; copies
  of a fingerprint meet the smallest key that has it. Those still apart after the rounds below are verified and joined
  then. Sets of similarity 0.8 are about ten bits apart, so most of such pairs are left to
* `BANDS` fingerprints of `ROWS` minima each: two documents of similarity s share one with probability
  1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8.

Candidates of the second kind are settled in rounds. In every fingerprint whose documents are not yet in one component, some documents become
pivots (1, then 64, and 256 in all later rounds, those of the smallest components there first); each is compared with
every document there of another component, and leaves: all its pairs are settled. Rounds go on until every fingerprint is one
component or has no pair left, so no candidate is dropped and none between documents already joined is looked at. A group
of near copies ends after a round or two; only many unlike documents in one fingerprint take more. Pairs whose sizes or
`BITS` bits rule the similarity out are not even made: a document sets a bit for each of its shingles, and every bit that the
other lacks is a shingle that the other lacks, which bounds what they share. A pivot with many pairs is salted: its shingles are sent once for every
`SHARE` pairs, which are dealt over as many places.

No document is linked below the similarity; a chain of links still joins its ends.

Nulls and edge cases: null and empty texts are the empty set and equal; a text of fewer words than a shingle is one
shingle; a null key links nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.llm import simhash_vp
from stratiform.llm.components import components
from stratiform.llm.frames import field, stored
from stratiform.llm.words import LOWER, POLY, Words, as_long, mix, runs, word_bytes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
PIVOTS = (1, 64, 256)
SHARE = 128
BITS = 512
RUN = 1 << 19
INSIDE = word_bytes("space")
SEEDS = np.random.default_rng(11).integers(1, 2**63, (BANDS * ROWS, 2), np.uint64) | np.uint64(1)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first place of each row and one more): the distinct shingles of each row in order."""
    hashes = words.hashes()
    at, h = words.windows(hashes, k)
    short = np.flatnonzero((words.n > 0) & (words.n < k))
    row = np.r_[words.row[at], short]
    h = np.r_[h, POLY.spans(hashes, words.first[short], words.first[short + 1])]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(words.n) + 1))


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """`BANDS` fingerprints of each row that has a shingle."""
    begin = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(begin), BANDS), np.uint64)
    for i, (shift, factor) in enumerate(SEEDS):
        band = i // ROWS
        out[:, band] = mix(out[:, band] * np.uint64(31) + np.minimum.reduceat((h ^ shift) * factor, begin) + np.uint64(band))
    return out


def marks(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, whole, n, bands): `whole` is a hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in runs(batch.column(1), RUN):
                h, first = shingle_sets(Words(LOWER[data], offsets, INSIDE), shingle)
                n = np.diff(first)
                bands, whole = fingerprints(h, first), np.zeros(len(n), np.uint64)
                if len(h):
                    whole[n > 0] = np.add.reduceat(mix(h + np.uint64(7)), first[:-1][n > 0])
                keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((n > 0) * BANDS)], pa.int32()), pa.array(as_long(bands.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(as_long(whole)), pa.array(n), keys], names=[key, "whole", "n", "bands"])

    long = T.LongType()
    kinds = [("whole", long), ("n", long), ("bands", T.ArrayType(long))]
    return docs.select(F.col(key), F.col(text).alias("t")).mapInArrow(run, T.StructType([field(docs, key), *(T.StructField(*x) for x in kinds)]))


def bitmaps(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """`BITS` bits of each row as words of 64: one set for each shingle."""
    out = np.zeros((len(first) - 1, BITS // 64), np.uint64)
    at = mix(h + np.uint64(13)) % np.uint64(BITS)
    np.bitwise_or.at(out, (np.repeat(np.arange(len(first) - 1), np.diff(first)), (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return out


def shingles(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(rep, n, bits, shingles) of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in runs(batch.column(1), RUN):
                h, first = shingle_sets(Words(LOWER[data], offsets, INSIDE), shingle)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(as_long(h)))
                bits = pa.array(as_long(bitmaps(h, first).ravel()))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1) * (BITS // 64), pa.int32()), bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(first)), bits, lists], names=["rep", "n", "bits", "shingles"])

    longs = T.ArrayType(T.LongType())
    kind = T.StructType([field(docs, key, "rep"), T.StructField("n", T.LongType()), T.StructField("bits", longs), T.StructField("shingles", longs)])
    return docs.select(F.col(key), F.col(text).alias("t")).mapInArrow(run, kind)


def joined(now: DataFrame, found: DataFrame) -> DataFrame:
    """(rep, root) of documents after more links; only the roots that they join move."""
    ends = found.join(now.select(F.col("rep").alias("a"), F.col("root").alias("u")), "a").join(now.select(F.col("rep").alias("b"), F.col("root").alias("v")), "b")
    moved = components(ends.select("u", "v").filter("u != v").distinct(), "u", "v").select(F.col("node").alias("old"), F.col("root").alias("new"))
    return stored(now.join(moved, F.col("root") == F.col("old"), "left").select("rep", F.coalesce("new", "root").alias("root")), "joined")


def most_alike(n: str, bits: str, other: str):
    """No more shingles of one document than this can be in the other."""
    lacked = [F.bit_count(F.col(bits)[i].bitwiseAND(F.bitwise_not(F.col(other)[i]))) for i in range(BITS // 64)]
    return F.col(n) - sum(lacked[1:], lacked[0])


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b), b a pivot, whose sets are similar."""
    load = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("places"))
    pivots = load.join(sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b")), "b")
    pivots = pivots.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).drop("places")
    dealt = pairs.join(load, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("places")).cast("int").alias("place"))
    both = dealt.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a")), "a").join(pivots, ["b", "place"])
    alike = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(alike >= similar * (F.col("n_a") + F.col("n_b") - alike)).select("a", "b")


def tree_pairs(reps: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, radius: int = simhash_vp.RADIUS) -> DataFrame:
    """Candidates (a, b): documents whose SimHash fingerprints are equal or linked by the vantage-point trees."""
    own = docs.join(reps.select(F.col("rep").alias(key)), key, "left_semi")
    marked = stored(simhash_vp.fingerprints(own, key, text, shingle).select(F.col(key).alias("rep"), "fp"), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("rep").alias("low")), "distinct")
    near = stored(simhash_vp.links(distinct, distinct.count(), radius), "trees")
    other = distinct.select(F.col("fp").alias("other"), F.col("low").alias("b"))
    across = near.join(distinct, "fp").join(other, "other").select(F.col("low").alias("a"), "b")
    equal = marked.join(distinct, "fp").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    return stored(across.unionByName(equal).filter("a != b").distinct(), "near")


def after_trees(now: DataFrame, near: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(rep, root) after the pairs of the trees whose ends are still apart are verified and joined."""
    ends = near.join(now.select(F.col("rep").alias("a"), F.col("root").alias("u")), "a").join(now.select(F.col("rep").alias("b"), F.col("root").alias("v")), "b")
    found = stored(verified(stored(ends.filter("u != v").select("a", "b"), "apart"), sets, similar), "verified")
    return now if found.isEmpty() else joined(now, found)


def links(sets: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, similar: float) -> DataFrame:
    """(rep, root) of documents that a tree or a fingerprint names, root by all their links: (rep, bands), one row a set. Shingles are kept for such documents alone."""
    near = tree_pairs(sets, docs, key, text, shingle)
    group = sets.select("rep", F.explode("bands").alias("band"))
    shared = group.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("top")).filter("low != top").select("band")
    group = stored(group.join(shared, "band"), "shared")
    named = group.select("rep").unionByName(near.select(F.explode(F.array("a", "b")).alias("rep")))
    nodes = stored(named.distinct(), "nodes")
    sets = stored(shingles(docs.join(nodes.select(F.col("rep").alias(key)), key, "left_semi"), key, text, shingle).dropDuplicates(["rep"]), "shingles")
    group = stored(group.join(sets.select("rep", "n", "bits"), "rep"), "sizes")
    now = nodes.withColumn("root", F.col("rep"))
    for turn in itertools.count():
        rooted = group.join(now, "rep")
        alike = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("own"))
        open_ = alike.groupBy("band").agg(F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("band")
        rooted = stored(rooted.join(alike.join(open_, "band"), ["band", "root"]), "open")
        if rooted.isEmpty():
            return after_trees(now, near, sets, similar)
        # documents of small components first: once each of them has met the rest, only the largest component is left
        order = Window.partitionBy("band").orderBy("own", F.xxhash64("rep", "band"), "rep")
        count = PIVOTS[min(turn, len(PIVOTS) - 1)]
        pivots = stored(rooted.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= count), "pivots")
        asked = pivots.select("band", F.col("rep").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
        alike = F.least(most_alike("n", "bits", "bits_b"), most_alike("n_b", "bits_b", "bits"))
        fits = (F.col("n") >= similar * F.col("n_b")) & (F.col("n_b") >= similar * F.col("n")) & (alike >= similar * (F.col("n") + F.col("n_b") - alike))
        pairs = rooted.join(asked, "band").filter((F.col("root") != F.col("root_b")) & fits)
        pairs = stored(pairs.select(F.col("rep").alias("a"), "b").distinct(), "candidates")
        found = stored(verified(pairs, sets, similar), "verified")
        if not found.isEmpty():
            now = joined(now, found)
        group = stored(rooted.select("rep", "band", "n", "bits").join(pivots.select("rep", "band"), ["rep", "band"], "left_anti"), "group")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """One row a document with a key: key and component_id, the smallest key linked with it over any number of links."""
    keyed = docs.filter(F.col(key).isNotNull())
    found = stored(marks(keyed, key, text, shingle), "marks")
    same = stored(found.groupBy("whole", "n").agg(F.min(key).alias("rep"), F.min("bands").alias("bands")), "same")  # equal sets have equal bands
    roots = links(same.select("rep", "bands"), keyed, key, text, shingle, similar).withColumnRenamed("rep", "node")
    named = same.join(roots, F.col("rep") == F.col("node"), "left").select("whole", "n", F.coalesce("root", "rep").alias("component_id"))
    return found.select(key, "whole", "n").join(named, ["whole", "n"]).select(key, "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest key stays, with its own columns.
    Rows with a null key stay; of rows that share a key one stays."""
    firsts = near_duplicates(docs, key, text, shingle, similar).filter(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = docs.join(firsts, key, "left_semi")
    repeats = docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1")
    if not repeats.isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.select(docs.columns).unionByName(docs.filter(F.col(key).isNull()))

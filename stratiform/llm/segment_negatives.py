"""Hard-negative mining by segment summaries: bounds of scores first, finer segments for what is left, then exact scores.

A vector is cut into segments; each keeps its mean m and its deviation s (root of the sum of squared differences from m).
For segments of L components the inner product of two vectors lies within sum(L * m * m') -+ sum(s * s'), since what is
left beside the means is bounded by Cauchy-Schwarz. `LENGTHS` names the segment lengths, coarse to fine. A (row, anchor)
pair whose interval cannot reach what the anchor still asks for is gone; the rest go on to the next length, and what is
left after the finest gets its exact score. What an anchor asks for: as a positive, its best scores so far, or the lower
bounds of enough rows before there are any; as a negative, the window of its positives and the best scores in it so far.

Scores are integers: components become floor(scale * x), and products run in float32 or float64 only where the norms
prove every partial sum exact, else in 64-bit integers. So the result is exact, whatever the bounds leave.

On Spark: rows are reduced to one a key and stored; anchors come in blocks of about `BLOCK_BYTES` (the bound of what is
collected and broadcast), dealt by a hash of their key; a block meets all rows in two scans without a shuffle of vectors
(positives, then negatives). A task holds a few best rows an anchor and hands those on; Spark ranks them by anchor, with
ranks limited before the shuffle. So a frequent label or vector is no shuffle key, and no pair is written unless it is
among the best of its task.

Nulls and edge cases: rows with a null key, label or vector, or a null, NaN or infinite component, take no part; rows of
one key are one item, that with the largest (label, vector); a component beyond +-2**16 counts as that; of vectors of
unequal lengths the shorter counts as filled with zeros, an empty vector scores 0 with all; equal scores go by smaller
key; an anchor without another row of its label has no positives and no rows, one whose windows are empty likewise (as
with negative positive scores); an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm.frames import stored

LENGTHS = (16, 4, 2)
BLOCK_BYTES = 8 << 20
ROWS, ANCHORS = 2048, 1024
CHUNK = 1 << 17
LARGEST = 1 << 16
DENSE = 0.2
NONE = np.iinfo(np.int64).min


def items(rows: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, q) with whole components, one row a key."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST))) * float(scale)).cast("int"))
    known = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return known.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.max(F.struct(F.col(label).cast("bigint").alias("label"), whole.alias("q"))).alias("r")).select("id", "r.*")


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """List column as rows filled with zeros to a multiple of the longest segment, at least `width`."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    width = max(width, int(size.max(initial=0)), 1)
    out = np.zeros((len(size), -(-width // LENGTHS[0]) * LENGTHS[0]), np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)
    out[np.repeat(np.arange(len(size)), size), place] = flat
    return out


class Vectors:
    """Rows with their keys, labels, exact components, norms and, when first asked for, segment summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        self.f = q.astype(float)
        self.norm = np.sqrt((self.f * self.f).sum(1))
        self.exact = {}
        self.summary = {}

    def __len__(self) -> int:
        return len(self.ids)

    def ready(self) -> Vectors:
        """Summaries made now, so that parts share them."""
        for length in LENGTHS:
            self.segments(length)
        return self

    def of(self, kind) -> np.ndarray:
        if kind not in self.exact:
            self.exact[kind] = self.q.astype(kind)
        return self.exact[kind]

    def segments(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Means times the root of the length, so that their products add up, and deviations."""
        if length not in self.summary:
            s = self.f.reshape(len(self.f), -1, length)
            mean = s.mean(2)
            self.summary[length] = (mean * np.sqrt(length)).astype(np.float32), np.sqrt(((s - mean[..., None]) ** 2).sum(2)).astype(np.float32)
        return self.summary[length]

    def part(self, at: np.ndarray) -> Vectors:
        out = object.__new__(Vectors)
        out.ids, out.labels, out.q, out.f, out.norm = self.ids[at], self.labels[at], self.q[at], self.f[at], self.norm[at]
        out.exact = {k: v[at] for k, v in self.exact.items()}
        out.summary = {k: (m[at], s[at]) for k, (m, s) in self.summary.items()}
        return out


def products(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """All products of rows, or those of the pairs named, in chunks."""
    if pairs is None:
        return a @ b.T
    out = [np.einsum("ij,ij->i", a[pairs[0][x : x + CHUNK]], b[pairs[1][x : x + CHUNK]]) for x in range(0, len(pairs[0]), CHUNK)]
    return np.concatenate(out) if out else np.zeros(0, a.dtype)


def surviving(rows: Vectors, anchors: Vectors, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, exact score) of the allowed pairs that may score between `least` and `most` of their anchor.

    An anchor without a `least` yet takes the lower bound that `first` of its allowed rows reach.
    """
    slack = 1 + 1e-5 * anchors.norm * rows.norm.max(initial=0)
    pairs = None
    alive = allowed
    for length in LENGTHS:
        (rm, rs), (am, as_) = rows.segments(length), anchors.segments(length)
        middle, width = products(rm, am, pairs), products(rs, as_, pairs)
        if pairs is None:
            open_ = np.flatnonzero(least == NONE)
            if len(open_) and first and len(rows) >= first:
                low = np.where(alive[:, open_], middle[:, open_] - width[:, open_], -np.inf)
                reached = np.partition(low, -first, axis=0)[-first] - slack[open_]
                least = least.copy()
                least[open_] = np.where(np.isfinite(reached), np.floor(np.nan_to_num(reached, neginf=0)), NONE)
            alive = alive & (middle + width >= (least - slack)[None]) & (middle - width <= (most + slack)[None])
            if np.count_nonzero(alive) <= DENSE * alive.size:
                pairs = np.nonzero(alive)
        else:
            r, a = pairs
            keep = (middle + width >= (least - slack)[a]) & (middle - width <= (most + slack)[a])
            pairs = r[keep], a[keep]
    top = rows.norm.max(initial=0) * anchors.norm.max(initial=0)
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    score = products(rows.of(kind), anchors.of(kind), pairs)
    if pairs is None:
        pairs = np.nonzero(alive)
        score = score[pairs]
    return *pairs, score.astype(np.int64)


@dataclass
class Best:
    """The best `k` (score, key) of each group; equal scores go by smaller key."""

    groups: int
    k: int

    def __post_init__(self):
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        group, score, id_ = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, group))
        group = group[order]
        first = np.searchsorted(group, group)
        keep = np.arange(len(group)) - first < self.k
        self.group, self.score, self.id = group[keep], score[order][keep], id_[order][keep]

    def least(self) -> np.ndarray:
        """The k-th score of each group, NONE where there are fewer."""
        out = np.full(self.groups, NONE)
        last = np.searchsorted(self.group, np.arange(self.groups), "right") - 1
        full = np.bincount(self.group, minlength=self.groups) == self.k
        out[full] = self.score[last[full]]
        return out


def blocks(batch: pa.RecordBatch, width: int) -> Iterator[Vectors]:
    for low in range(0, batch.num_rows, ROWS):
        part = batch.slice(low, ROWS)
        yield Vectors(part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width))


def widened(anchors: Vectors, width: int) -> Vectors:
    if anchors.q.shape[1] < width:
        anchors = Vectors(anchors.ids, anchors.labels, np.pad(anchors.q, ((0, 0), (0, width - anchors.q.shape[1]))))
    return anchors.ready()


def best_positives(batches: Iterator[pa.RecordBatch], anchors: Vectors, k: int) -> Best:
    """The best other rows of each anchor's label among the batches."""
    found = Best(len(anchors), k)
    for batch in batches:
        for rows in blocks(batch, anchors.q.shape[1]):
            anchors = widened(anchors, rows.q.shape[1])
            least = found.least()
            for label in np.intersect1d(rows.labels, anchors.labels):
                own = rows.part(np.flatnonzero(rows.labels == label))
                at = np.flatnonzero(anchors.labels == label)
                for low in range(0, len(at), ANCHORS):
                    a = at[low : low + ANCHORS]
                    some = anchors.part(a)
                    r, c, score = surviving(own, some, own.ids[:, None] != some.ids[None], least[a], np.full(len(a), np.inf), k)
                    keep = score >= least[a][c]
                    found.add(a[c[keep]], score[keep], own.ids[r[keep]])
    return found


def best_negatives(batches: Iterator[pa.RecordBatch], anchors: Vectors, low_: np.ndarray, high: np.ndarray, k: int) -> Best:
    """The best rows of other labels in each window of each anchor; group = anchor * windows + window, low > high where there is none."""
    windows = low_.shape[1]
    found = Best(low_.size, k)
    open_ = low_ <= high
    asking = np.flatnonzero(open_.any(1))
    for batch in batches:
        for rows in blocks(batch, anchors.q.shape[1]):
            anchors = widened(anchors, rows.q.shape[1])
            least = np.where(open_, np.maximum(found.least().reshape(low_.shape), low_), np.iinfo(np.int64).max)
            most = np.where(open_, high, NONE)
            for begin in range(0, len(asking), ANCHORS):
                a = asking[begin : begin + ANCHORS]
                some = anchors.part(a)
                r, c, score = surviving(rows, some, rows.labels[:, None] != some.labels[None], least[a].min(1), most[a].max(1).astype(float), 0)
                inside = (score[:, None] >= least[a][c]) & (score[:, None] <= most[a][c])
                pair, w = np.nonzero(inside)
                found.add(a[c[pair]] * windows + w, score[pair], rows.ids[r[pair]])
    return found


def limits(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores n with low * score <= 100 * n <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). `is_anchor` is a condition on the column `id`."""
    spark = rows.sparkSession
    table = stored(items(rows, key, label, vector, scale), "vectors")
    anchors = table.filter(is_anchor)
    size = anchors.agg(F.coalesce(F.sum(4 * F.size("q") + 16), F.lit(0))).first()[0]
    count = max(1, -(-size // block_bytes))
    parts = [_block(spark, table, anchors.filter(F.pmod(F.xxhash64("id"), F.lit(count)) == b), positives, negatives, low, high) for b in range(count)]
    return reduce(DataFrame.unionByName, parts)


def _block(spark, table: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    own = anchors.toArrow().combine_chunks().sort_by("id")
    ids, labels = own["id"].to_numpy(), own["label"].to_numpy()
    vectors = own["q"].combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.int32()))
    sent = spark.sparkContext.broadcast((ids, labels, matrix(vectors).astype(np.int32)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Vectors(sent.value[0], sent.value[1], sent.value[2].astype(np.int64))
        b = best_positives(batches, a, positives)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.ids[b.group], b.id, b.score)], names=["anchor", "id", "score"])

    close = stored(ranked(table.mapInArrow(near, "anchor bigint, id bigint, score bigint"), ["anchor"], positives), "positives")
    known = close.toArrow()  # at most `positives` rows an anchor of the block
    at, rank, score = np.searchsorted(ids, known["anchor"].to_numpy()), known["rank"].to_numpy() - 1, known["score"].to_numpy()
    of, base = (np.zeros((len(ids), positives), np.int64) for _ in range(2))
    least, most = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
    of[at, rank], base[at, rank] = known["id"].to_numpy(), score
    least[at, rank], most[at, rank] = limits(score, low, high)
    asked = spark.sparkContext.broadcast((of, base, least, most))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Vectors(sent.value[0], sent.value[1], sent.value[2].astype(np.int64))
        of, base, least, most = asked.value
        b = best_negatives(batches, a, least, most, negatives)
        x, w = b.group // positives, b.group % positives
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a.ids[x], of[x, w], base[x, w], b.id, b.score)], names=["anchor", "positive", "base", "id", "score"])

    found = table.mapInArrow(hard, "anchor bigint, positive bigint, base bigint, id bigint, score bigint")
    out = stored(ranked(found, ["anchor", "positive"], negatives), "negatives")
    asked.unpersist()
    sent.unpersist()
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("base").alias("positive_score"), F.col("score").alias("negative_score"),
    )

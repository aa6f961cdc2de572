"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairs cost linear time by
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Inputs of a score are the text and `metadata` columns (numbers, such as a length); never a label, language, source
or key. Words are hashed to `BUCKETS` features with value log(1 + count), scaled to length 1 a document; each
statistic and each metadata column is cut into `CUTS` fixed bins and gives one feature of value `STAT`.

The model is fitted on at most `MAX_TRAIN` labelled rows (those with the smallest hash of the key), the one bound
here; what the driver holds is at most MAX_TRAIN * (BUCKETS + statistics) feature values. Scoring is one pass over
whole texts without a shuffle.

Nulls and edge cases: a null or empty text has no words and is scored by its statistics; a null metadata value has a
bin of its own; labels that are null or whose key is null are not learned from; a key labelled twice counts once,
with its larger label; without any label of both kinds the score is the mean label, or 0.5; repeated rows get the
same score; other columns pass by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.llm.frames import field
from stratiform.llm.words import Words, runs, word_bytes

MAX_TRAIN = 5_000
BUCKETS = 1 << 12
CUTS = 16
STAT = 0.5
RANK = 8
ROUNDS = 12
THRESHOLD = 0.3
INSIDE, LINES = word_bytes("space"), word_bytes("line")
CLASSES = (b"#*$%&|<>@^~_=+\\{}[]", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b"\n")
N_STATS = len(CLASSES) + 6
LEVELS = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85, 0.97])


def statistics(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A column of values from 0 to 1 for each statistic: shares of bytes by class, repeats, lengths."""
    size = np.maximum(np.diff(words.offsets), 1)
    n = np.maximum(words.n, 1)
    out = []
    for members in CLASSES:
        flag = np.zeros(256, bool)
        flag[list(members)] = True
        sums = np.zeros(len(words.data) + 1, np.int64)
        np.cumsum(flag[words.data], out=sums[1:])
        out.append((sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / size)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    out.append(words.per_row(same) / n)
    out.append(np.minimum(words.per_row(words.end - words.start) / n / 20, 1))
    out.append(np.minimum(np.log2(1 + words.n) / 16, 1))
    out.append(words.per_row((words.end - words.start) == 1) / n)
    lines = Words(words.data, words.offsets, LINES)
    pair = np.stack([lines.row.astype(np.uint64), lines.hashes()])
    distinct = np.bincount(np.unique(pair, axis=1)[0].astype(np.int64), minlength=len(words.n)) if len(lines.row) else np.zeros(len(words.n))
    out.append(1 - distinct / np.maximum(lines.n, 1))
    out.append(np.minimum(np.log2(1 + lines.n) / 16, 1))
    return np.stack(out, axis=1)


def features(words: Words, metadata: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each row and one more, feature, value): words by bucket, then bins of statistics."""
    hashes = words.hashes()
    rows = len(words.n)
    key, count = np.unique(words.row * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, value = key // BUCKETS, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, rows))
    value = value / norm[row]
    bins = [np.searchsorted(LEVELS, column, "right") for column in statistics(words, hashes).T]
    for column in metadata:
        known = ~np.isnan(column)
        bins.append(np.where(known, 1 + np.minimum(np.log2(1 + np.abs(np.where(known, column, 0))), CUTS - 2).astype(np.int64), 0))
    stats = BUCKETS + np.arange(len(bins)) * CUTS + np.stack(bins, axis=1)
    first = np.searchsorted(row, np.arange(rows + 1))
    at = np.repeat(first[1:], len(bins))
    feature = np.insert(key % BUCKETS, at, stats.ravel())
    return first + np.arange(rows + 1) * len(bins), feature, np.insert(value, at, STAT)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Every row has features, since statistics always do."""
        at = first[:-1]
        if not len(at):
            return np.zeros(0)
        vx = self.factors[feature] * value[:, None]
        sums = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), at)
        return self.bias + np.add.reduceat(self.weights[feature] * value, at) + 0.5 * ((sums * sums).sum(1) - squares)

    def score(self, *parts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*parts), -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, seed: int = 7) -> Machine:
    """Logistic loss by Adagrad over batches of rows."""
    rng = np.random.default_rng(seed)
    mean = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    m = Machine(float(np.log(mean / (1 - mean))), np.zeros(size), rng.normal(0, 0.03, (size, RANK)))
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    gw, gv, g0, rate, decay = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6, 0.1, 1e-4
    for _ in range(ROUNDS):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), 64):
            batch = order[low : low + 64]
            first = np.cumsum([0, *(len(rows[i][0]) for i in batch)])
            feature, value = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
            error = (m.score(first, feature, value) - labels[batch]) / len(batch)
            own = np.repeat(np.arange(len(batch)), np.diff(first))
            vx = m.factors[feature] * value[:, None]
            sums = np.add.reduceat(vx, first[:-1], axis=0)
            used, place = np.unique(feature, return_inverse=True)
            step = error[own] * value
            dw = np.bincount(place, step, len(used)) + decay * m.weights[used]
            pairs = step[:, None] * (sums[own] - vx)
            dv = np.stack([np.bincount(place, pairs[:, f], len(used)) for f in range(RANK)], axis=1) + decay * m.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += error.sum() ** 2
            m.weights[used] -= rate * dw / np.sqrt(gw[used])
            m.factors[used] -= rate * dv / np.sqrt(gv[used])
            m.bias -= rate * error.sum() / np.sqrt(g0)
    return m


def meta(batch: pa.RecordBatch, first: int, low: int, high: int) -> list[np.ndarray]:
    return [batch.column(i).slice(low, high - low).to_numpy(zero_copy_only=False).astype(float) for i in range(first, batch.num_columns)]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: Sequence[str] = (), usable: Column | None = None, max_train: int = MAX_TRAIN) -> Machine:
    """Fits on the labelled rows that `usable` (a condition on the key column of `labels`) lets pass."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known if usable is None else known.filter(usable)
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(max_train)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)))
    rows = slim.join(F.broadcast(known), "key").dropDuplicates(["key"]).select("key", "label", "text", *(f"m{i}" for i in range(len(metadata))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in runs(batch.column(2)):
                first, feature, value = features(Words(data, offsets, INSIDE), meta(batch, 3, low, high))
                pairs = [np.rec.fromarrays([feature[a:b], value[a:b]], dtype=[("f", "<i4"), ("v", "<f4")]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).cast(pa.string()), batch.column(1).slice(low, high - low), pa.array(pairs, pa.binary())], names=["key", "label", "pairs"])

    sample = sorted(rows.mapInArrow(run, "key string, label int, pairs binary").collect())
    parts = [np.frombuffer(x["pairs"], [("f", "<i4"), ("v", "<f4")]) for x in sample]
    size = BUCKETS + (N_STATS + len(metadata)) * CUTS
    return fit([(p["f"].astype(np.int64), p["v"].astype(float)) for p in parts], np.array([x["label"] for x in sample], float), size)


def scores(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", metadata: Sequence[str] = ()) -> DataFrame:
    """One row a document: key and score."""
    slim = docs.select(F.col(key), F.col(text).alias("t"), *(F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)))
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in runs(batch.column(1)):
                score = sent.value.score(*features(Words(data, offsets, INSIDE), meta(batch, 2, low, high)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(score)], names=[key, "score"])

    return slim.mapInArrow(run, T.StructType([field(docs, key), T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, machine: Machine, text: str = "text", metadata: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least the threshold, with their own columns."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    wide = docs.select("*", *(F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(metadata)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for low, high, data, offsets in runs(batch.column(names.index(text))):
                keep.append(sent.value.score(*features(Words(data, offsets, INSIDE), meta(batch, len(names), low, high))) >= threshold)
            yield batch.select(range(len(names))).filter(pa.array(np.concatenate(keep)))

    return wide.mapInArrow(run, docs.schema)

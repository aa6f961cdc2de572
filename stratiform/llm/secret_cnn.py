"""Secret scans: base patterns, and a character convolutional network over every candidate with its surroundings.

Base kinds (assign, access, hex) are patterns over whole texts. Candidates are the runs of at least `SHORTEST` token
characters and every run that a base finding lies in. The network reads `AROUND` bytes on both sides and the whole
candidate: an embedding a byte plus one a part (before, candidate, after), one convolution of width `WIDTH`, the largest
value of each filter a part, a hidden layer, one output. Candidates of any length are read whole, in blocks of positions.

Labelled findings: a candidate that overlaps a base finding is a secret, another is none. All distinct ones, by their bytes
and surroundings, are learned or held apart: a third of them, by hash, calibrates, the others are dealt by hash over
shards of about `SHARD`, whose number follows from the candidates and not from partitions. Findings of the rarer label go
to several shards, as many as balance the labels, and repeat within a shard. The network is warmed up on the first shard;
if there are more, each learns all its findings from the common weights, which become the mean of the shards' (added as
whole numbers, so the order of tasks does not matter). Every finding held apart is counted by kind and output,
to 1/`GRID`; on these counts scores are calibrated (Platt), and each base kind gives the largest threshold that at least
`RECALL` of its findings reach; the smallest of those decides, so no kind falls under that recall. Half of the time a window
is learned with blanks around its value, and a score is the larger of both views: a keyless copy of what elsewhere has a
key is told by its value alone, although its surroundings were labelled as those of no secret. A candidate outside base
findings that reaches the threshold is a span of kind `model`.

Two passes over the texts (findings, scan), no shuffle of texts, only of candidates, one row a document; candidates with
the same bytes and surroundings are learned once and scored once a run of rows. The driver sees counts and weights alone.
Without findings of both labels no span is added.

Nulls and edge cases: a null or empty text has no findings; a null key is a key like others; repeated rows give repeated
rows; very long texts are one row, scanned whole; places are code points, ends are exclusive; an empty table gives no
rows; other columns, whatever their names, pass by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field as field_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.llm.frames import field, stored
from stratiform.llm.words import runs

# Fixed values of the base kinds, in their order; patterns work on bytes, letters of the first on lower-cased bytes.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # a run is found whole, so its length can be asked for at once
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
SHORTEST = 12
AROUND = 20
WIDTH = 5
DIM, FILTERS, HIDDEN = 8, 16, 16
BLANK = 0
SHARD, SHARD_BYTES = 1 << 15, 1 << 25
ROUNDS, STEPS = 12, 200
BATCH, SMOOTH = 64, 0.05
GRID, WIDEST = 256, 512
RECALL = 0.95
BLOCK = 1 << 15


def base_findings(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes, sorted; matches of a kind never overlap, too short ones are dropped."""
    found = [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text.lower()) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Scan:
    """Findings and candidates of a run of rows; places are bytes of the run."""

    data: np.ndarray
    offsets: np.ndarray
    findings: list[list[tuple[int, int, int, int]]] = field_(default_factory=list)

    def __post_init__(self):
        raw, o = self.data.tobytes(), self.offsets
        self.findings = [base_findings(raw[o[i] : o[i + 1]]) for i in range(len(o) - 1)]
        token = np.zeros(len(self.data) + 2, bool)
        token[1:-1] = TOKEN[self.data]
        border = np.zeros(len(self.data) + 1, bool)
        border[o] = True
        start = np.flatnonzero(token[1:] & (~token[:-1] | border))
        end = np.flatnonzero(token[:-1] & (~token[1:] | border))
        kind = np.full(len(start), -1)
        for row, found in enumerate(self.findings):
            for _, k, last, value in found:
                # the runs that the value lies in; a run has the kind found last
                low, high = np.searchsorted(end, o[row] + value, "right"), np.searchsorted(start, o[row] + last)
                kind[low:high] = k
        keep = (end - start >= SHORTEST) | (kind >= 0)
        self.start, self.end, self.kind = start[keep], end[keep], kind[keep]
        self.row = np.searchsorted(o, self.start, "right") - 1

    def windows(self) -> list[bytes]:
        """Bytes before (filled up with blanks), candidate, bytes after, all of the candidate's own row."""
        raw, o = self.data.tobytes(), self.offsets
        out = []
        for a, b, r in zip(self.start.tolist(), self.end.tolist(), self.row.tolist(), strict=True):
            before, after = raw[max(a - AROUND, int(o[r])) : a], raw[b : min(b + AROUND, int(o[r + 1]))]
            out.append(before.rjust(AROUND, b"\0") + raw[a:b] + after.ljust(AROUND, b"\0"))
        return out


def positions(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows in one row of bytes with blanks between them: byte, part (1 to 3, 0 between), segment (3 a window, -1 between)."""
    gap = b"\0" * (WIDTH // 2)
    data = np.frombuffer(gap + gap.join(windows) + gap, np.uint8)
    size = np.array([len(w) for w in windows])
    lengths = np.stack([np.full(len(size), AROUND), size - 2 * AROUND, np.full(len(size), AROUND), np.full(len(size), len(gap))], axis=1).ravel()
    part = np.repeat(np.tile([1, 2, 3, 0], len(size)), lengths)
    segment = np.repeat((np.arange(len(size))[:, None] * 3 + np.array([0, 1, 2, 0])[None]).ravel(), lengths)
    lead = np.zeros(len(gap), np.int64)
    part, segment = np.concatenate([lead, part]), np.concatenate([lead, segment])
    return data, part, np.where(part > 0, segment, -1)


def alone(window: bytes) -> bytes:
    """A window with blanks around its value."""
    return b"\0" * AROUND + window[AROUND:-AROUND] + b"\0" * AROUND


@dataclass
class Network:
    """Weights, calibration and threshold; without a threshold nothing is found."""

    w: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = float("inf")

    def blocks(self, data: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, inputs, values of the filters) of blocks of positions."""
        half = WIDTH // 2
        for low in range(0, len(data), BLOCK):
            high = min(low + BLOCK, len(data))
            first, last = max(low - half, 0), min(high + half, len(data))
            x = self.w["byte"][data[first:last]] + self.w["part"][part[first:last]]
            x = np.pad(x, ((half - (low - first), half - (last - high)), (0, 0)))
            stack = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=0).transpose(0, 2, 1).reshape(high - low, -1)
            yield low, high, stack, np.maximum(stack @ self.w["conv"] + self.w["conv_bias"], 0)

    def pooled(self, blocks: Iterator[tuple[int, int, np.ndarray, np.ndarray]], segment: np.ndarray) -> np.ndarray:
        """Largest value of each filter by segment."""
        out = np.zeros((int(segment.max(initial=-1)) + 1, FILTERS), np.float32)
        for low, high, _, value in blocks:
            own = segment[low:high]
            at = np.flatnonzero(own >= 0)
            if len(at):
                begin = at[np.flatnonzero(np.diff(own[at], prepend=-1))]
                top = np.maximum.reduceat(np.where((own >= 0)[:, None], value, 0), begin, axis=0)
                out[own[begin]] = np.maximum(out[own[begin]], top)
        return out

    def raw(self, windows: list[bytes]) -> np.ndarray:
        if not windows:
            return np.zeros(0, np.float32)
        data, part, segment = positions(windows)
        pooled = self.pooled(self.blocks(data, part), segment).reshape(len(windows), -1)
        return np.maximum(pooled @ self.w["hidden"] + self.w["hidden_bias"], 0) @ self.w["out"] + self.w["out_bias"]

    def margin(self, windows: list[bytes]) -> np.ndarray:
        """The larger output of two views: with surroundings, and the value alone."""
        return np.maximum(self.raw(windows), self.raw([alone(w) for w in windows]))

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))

    def margins(self, windows: list[bytes]) -> np.ndarray:
        """`margin`, worked on in groups of windows of bounded size."""
        out, low = [np.zeros(0, np.float32)], 0
        size = np.cumsum([len(w) for w in windows]) if windows else np.zeros(0, int)
        while low < len(windows):
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + 8 * BLOCK)))
            out.append(self.margin(windows[low:high]))
            low = high
        return np.concatenate(out)

    def score(self, windows: list[bytes]) -> np.ndarray:
        """Calibrated probability."""
        return self.probability(self.margins(windows))


def balanced(label: np.ndarray) -> np.ndarray:
    """Every place, those of the rarer label as often as it takes to match the other."""
    rare, other = sorted((np.flatnonzero(label > 0), np.flatnonzero(label <= 0)), key=len)
    return np.sort(np.concatenate([np.repeat(rare, max(len(other) // max(len(rare), 1), 1)), other]))


def weights(seed: int = 11) -> dict[str, np.ndarray]:
    """Random weights to start from."""
    rng = np.random.default_rng(seed)
    shapes = {
        "byte": (256, DIM), "part": (4, DIM), "conv": (WIDTH * DIM, FILTERS), "conv_bias": (FILTERS,),
        "hidden": (3 * FILTERS, HIDDEN), "hidden_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (),
    }
    return {k: np.asarray(rng.normal(0, 0.3 if k in ("byte", "part") else (2 / max(s[0], 1)) ** 0.5 if len(s) else 0, s) if not k.endswith("bias") else np.zeros(s), np.float32) for k, s in shapes.items()}


def learn(windows: list[bytes], label: np.ndarray, seed: int = 11, start: dict[str, np.ndarray] | None = None, rounds: int = ROUNDS, rate: float = 0.01) -> Network:
    """Logistic loss by Adam over batches of windows, from given weights or random ones; every window is learned `rounds` times.

    Labels are smoothed, so that a key beside a value does not raise an output far above that of the value alone."""
    rng = np.random.default_rng(seed)
    w = {k: v.copy() for k, v in (start or weights(seed)).items()}
    net = Network(w)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    places, aim, step = balanced(label), SMOOTH + (1 - 2 * SMOOTH) * label, 0
    for _ in range(rounds):
        order = places[rng.permutation(len(places))]
        for low in range(0, len(order), BATCH):
            pick = order[low : low + BATCH]
            blank = rng.random(len(pick)) < 0.5
            batch = [alone(windows[i]) if b else windows[i] for i, b in zip(pick, blank, strict=True)]
            data, part, segment = positions(batch)
            # values of long batches are made twice and never kept whole
            kept = list(net.blocks(data, part)) if len(data) <= 8 * BLOCK else None
            flat = net.pooled(kept or net.blocks(data, part), segment)
            pooled = flat.reshape(len(batch), -1)
            hidden = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"], -35, 35))) - aim[pick]) / len(pick)
            grad = {"out": hidden.T @ error, "out_bias": error.sum()}
            back = np.outer(error, w["out"]) * (hidden > 0)
            grad |= {"hidden": pooled.T @ back, "hidden_bias": back.sum(0)}
            top = (back @ w["hidden"].T).reshape(-1, FILTERS)
            # a filter's largest value passes its error to the places that have it
            hits = []
            ties = np.zeros((len(flat), FILTERS))
            for low_, high_, stack, value in kept or net.blocks(data, part):
                own = segment[low_:high_]
                at, f = np.nonzero((own >= 0)[:, None] & (value > 0) & (value == flat[np.maximum(own, 0)]))
                np.add.at(ties, (own[at], f), 1)
                hits.append((low_ + at, f, stack[at]))
            at, f, stack = (np.concatenate(x) for x in zip(*hits, strict=True))
            share = (top / np.maximum(ties, 1))[segment[at], f].astype(np.float32)
            grad["conv_bias"] = np.bincount(f, share, FILTERS)
            grad["conv"] = np.zeros((WIDTH * DIM, FILTERS), np.float32)
            down = (share[:, None] * w["conv"].T[f]).reshape(len(at), WIDTH, DIM)
            grad |= {"byte": np.zeros((256, DIM)), "part": np.zeros((4, DIM))}
            for one in range(FILTERS):
                grad["conv"][:, one] = share[f == one] @ stack[f == one]
            for i in range(WIDTH):
                place = at + i - WIDTH // 2
                inside = (place >= 0) & (place < len(data))
                for d in range(DIM):
                    grad["byte"][:, d] += np.bincount(data[place[inside]], down[inside, i, d], 256)
                    grad["part"][:, d] += np.bincount(part[place[inside]], down[inside, i, d], 4)
            step += 1
            for k, g in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def calibrate(net: Network, windows: list[bytes], kind: np.ndarray, recall: float = RECALL) -> Network:
    """Platt's slope and shift, then the threshold that keeps the recall of every kind."""
    return fitted(net, net.margins(windows), kind, np.ones(len(kind)), recall)


def fitted(net: Network, margin: np.ndarray, kind: np.ndarray, count: np.ndarray, recall: float = RECALL) -> Network:
    """`calibrate` by the number of findings of each output and kind; Platt by damped Newton steps."""
    raw, label = margin.astype(float), (kind >= 0).astype(float)
    known, other = (count * label).sum(), (count * (1 - label)).sum()
    target = np.where(label > 0, (known + 1) / (known + 2), 1 / (other + 2))
    size = max(float(np.abs(raw).max()), 1.0)
    x = np.stack([raw / size, np.ones(len(raw))], axis=1)
    w = np.array([size, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((count * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (count * (p - target)))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    a, b = w[0] / size, w[1]
    net.slope, net.shift = max(float(a), 1e-3), float(b)
    score = net.probability(margin)
    # the share `recall` of a kind's findings scores at least this
    each = []
    for k in set(kind[kind >= 0].tolist()):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(score[own], kind="stable")]
        total = np.cumsum(count[own])
        each.append(score[own[np.searchsorted(total, int((1 - recall) * total[-1]), "right")]])
    net.threshold = min(each, default=float("inf"))
    return net


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """(mark, bytes, kind, secret, apart): all distinct candidates of either label, by a hash of their bytes and surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in runs(batch.column(0)):
                scan = Scan(data, offsets)
                own: dict[tuple[bytes, bool], int] = {}
                for window, kind in zip(scan.windows(), scan.kind.tolist(), strict=True):
                    own[window, kind >= 0] = max(kind, own.get((window, kind >= 0), -1))
                marks = [hashlib.blake2b(window, digest_size=16).digest() for window, _ in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks, pa.binary()), pa.array([x for x, _ in own], pa.binary()), pa.array(list(own.values()), pa.int32())], names=["mark", "bytes", "kind"]
                )

    found = docs.select(F.col(text).alias("t")).mapInArrow(run, "mark binary, bytes binary, kind int")
    distinct = found.groupBy("mark", (F.col("kind") >= 0).alias("secret")).agg(F.first("bytes").alias("bytes"), F.max("kind").alias("kind"))
    return stored(distinct.withColumn("apart", F.xxhash64("mark") % 3 == 0), "findings")


def dealt(found: DataFrame, shards: int, copies: dict[bool, int]) -> DataFrame:
    """`found` with a column `shard`; a finding goes to as many shards as its label has copies."""
    count = F.when(F.col("secret"), copies[True]).otherwise(copies[False])
    place = F.explode(F.sequence(F.lit(0), count - 1)).alias("i")
    return found.select("*", place).withColumn("shard", F.pmod(F.xxhash64("mark", F.lit(1)) + F.col("i"), F.lit(shards)).cast("int")).drop("i")


def in_order(group: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Windows and kinds of a shard, in an order of their own."""
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("mark", "kind", "bytes")), strict=True))
    return [x[2] for x in rows], np.array([x[1] for x in rows], int)


def mean_weights(groups: DataFrame, fit: Callable[[list[bytes], np.ndarray], dict[str, np.ndarray]], like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean of the weights that `fit` gives for each shard; tasks add their own ones up."""

    def one(group: pa.Table) -> pa.Table:
        w = fit(*in_order(group))
        flat = np.concatenate([w[k].ravel() for k in like]).astype(float)
        return pa.table({"n": [1], "w": pa.array([np.rint(flat * 2.0**32).astype(np.int64).tolist()], pa.list_(pa.int64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            for row in batch.column(1):
                n, total = n + 1, total + row.values.to_numpy()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "w"])

    rows = groups.groupBy("shard").applyInArrow(one, "n bigint, w array<bigint>").mapInArrow(add, "n bigint, w array<bigint>").collect()
    total = sum(np.array(r.w, np.int64) for r in rows) / 2.0**32 / sum(r.n for r in rows)
    out, at = {}, 0
    for k, v in like.items():
        out[k] = total[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def outputs(found: DataFrame, shards: int, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Output (to 1/`GRID`, downwards), kind and number of findings."""
    sent = found.sparkSession.sparkContext.broadcast(net)

    def one(group: pa.Table) -> pa.Table:
        windows, kind = in_order(group)
        step = np.floor(np.clip(sent.value.margins(windows), -WIDEST, WIDEST) * GRID).astype(np.int64)
        both, n = np.unique(np.stack([kind, step]), axis=1, return_counts=True)
        return pa.table({"kind": pa.array(both[0]), "step": pa.array(both[1]), "n": pa.array(n)})

    counted = dealt(found, shards, {True: 1, False: 1}).groupBy("shard").applyInArrow(one, "kind bigint, step bigint, n bigint")
    rows = counted.groupBy("kind", "step").agg(F.sum("n").alias("n")).orderBy("kind", "step").collect()
    kind, step, n = (np.array([r[c] for r in rows], np.int64) for c in range(3))
    return (step / GRID).astype(np.float32), kind, n


def train(docs: DataFrame, text: str = "text", shard: int = SHARD, recall: float = RECALL) -> Network:
    """Fits on all distinct candidates of either label; a third of them calibrate."""
    found = labelled(docs, text)
    sums = found.groupBy("secret", "apart").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("bytes")).alias("size")).collect()
    number = {(r.secret, r.apart): r.n for r in sums}
    if len(number) < 4:
        return Network({})

    def shards_of(apart: bool) -> int:
        return max(-(-sum(n for (_, a), n in number.items() if a == apart) // shard), -(-sum(r["size"] for r in sums if r.apart == apart) // SHARD_BYTES))

    shards = shards_of(False)
    have = {secret: number[secret, False] for secret in (True, False)}
    most = max(have.values())
    known = dealt(found.filter("not apart"), shards, {k: min(shards, max(1, most // n)) for k, n in have.items()})
    like = weights()

    def warm(windows: list[bytes], kind: np.ndarray) -> dict[str, np.ndarray]:
        label = (kind >= 0).astype(np.float32)
        return learn(windows, label, rounds=min(ROUNDS, -(-STEPS * BATCH // len(balanced(label))))).w

    now = mean_weights(known.filter("shard = 0"), warm, like)
    if shards > 1:
        sent = docs.sparkSession.sparkContext.broadcast(now)

        def fit(windows: list[bytes], kind: np.ndarray) -> dict[str, np.ndarray]:
            return learn(windows, (kind >= 0).astype(np.float32), 12, sent.value, 1, 0.003).w

        now = mean_weights(known, fit, like)
    net = Network(now)
    return fitted(net, *outputs(found.filter("apart"), shards_of(True), net), recall)


def row_spans(scan: Scan, net: Network) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in code points of every row, sorted."""
    other = np.flatnonzero(scan.kind < 0) if np.isfinite(net.threshold) else np.zeros(0, int)
    added = np.zeros(0, int)
    if len(other):
        windows = scan.windows()
        places: dict[bytes, int] = {}
        which = np.array([places.setdefault(windows[i], len(places)) for i in other])
        added = other[(net.score(list(places)) >= net.threshold)[which]]
    begins = np.concatenate([[0], np.cumsum((scan.data & 0xC0) != 0x80)])
    o = scan.offsets
    out = []
    extra: dict[int, list[int]] = {}
    for i in added.tolist():
        extra.setdefault(int(scan.row[i]), []).append(i)
    for row, found in enumerate(scan.findings):
        spans = [(o[row] + a, k, o[row] + b) for a, k, b, _ in found]
        spans += [(scan.start[i], 3, scan.end[i]) for i in extra.get(row, [])]
        out.append(sorted((int(begins[a] - begins[o[row]]), k, int(begins[b] - begins[o[row]])) for a, k, b in spans))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def findings(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, findings by kind, and all base and all spans as kind:start:end."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    slim = docs.select(F.col(key), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in runs(batch.column(1)):
                rows = row_spans(Scan(data, offsets), sent.value)
                counts = [pa.array([sum(x[1] == k for x in spans) for spans in rows], pa.int64()) for k in range(len(KINDS))]
                base = pa.array([written([x for x in spans if x[1] < 3]) for spans in rows], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *counts, base, pa.array([written(x) for x in rows], pa.string())], names=names)

    schema = T.StructType([field(docs, key), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())])
    names = schema.names
    return slim.mapInArrow(run, schema)


def redacted(docs: DataFrame, net: Network, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by `mask`; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for low, high, data, offsets in runs(batch.column(place)):
                own = batch.column(place).slice(low, high - low).to_pylist()
                for value, spans in zip(own, row_spans(Scan(data, offsets), sent.value), strict=True):
                    pieces, at = [], 0
                    for a, _, b in spans:
                        if a >= at:
                            pieces += [value[at:a], mask]
                        at = max(at, b)
                    out.append(value if not spans else "".join([*pieces, value[at:]]))
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)

"""Secret scan, filter audit and hard negatives against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratiform.llm import filter_lattice, queries, secret_cnn, segment_negatives

# Secrets

PATTERNS = (
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
)


def base_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == 0 else m[0]) >= (6, 20, 24)[kind]:
                found.append((m.start(), kind, m.end()))
    return ",".join(f"{secret_cnn.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


HARD = [
    None, "", " \n", "password=abcdef", "PassWord: 'abcde'", "paſſword=abcdefgh", "toKen=abcdefgh", "token==abcdefg", "secret=token:abcdefgh",
    'é日 api_key" : "XYZ123456é', "apikey=aaaaaa api-key=bbbbbb", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "Z9" * 8, "a" * 24, "g" + "0" * 23 + "g",
    "tokentoken=abcdef", "token =\tabcdef", "token=" + "f" * 30, "x" * 300_000 + " passwd:" + "q" * 50_000, "token=abc\ntoken=abcdef", "日本" + "0f" * 14 + "語",
]


def secret_docs(spark):
    rows = [(i, t, "en", 1, "x") for i, t in enumerate(HARD)]
    return spark.createDataFrame([*rows, rows[3], (None, HARD[3], None, None, None)], "doc_id bigint, text string, lang string, n_hex int, spans string")


def test_base_findings_equal_brute_force(spark):
    docs = secret_docs(spark)
    rows = secret_cnn.findings(docs, secret_cnn.Network({})).collect()
    assert len(rows) == len(HARD) + 2
    for r in rows:
        want = base_spans(HARD[3] if r.doc_id is None else HARD[r.doc_id])
        assert r.base_spans == r.spans == want, r.doc_id
        assert [r.n_assign, r.n_access, r.n_hex, r.n_model] == [want.count(k) for k in secret_cnn.KINDS]
    assert secret_cnn.findings(docs.limit(0), secret_cnn.Network({})).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Prose with keyed values of mixed letters and digits, and some such values without a key."""
    pick = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    value = lambda n: "".join(pick.choice(letters) for _ in range(n))
    words = ["information", "responsibility", "characterisation", "the", "internationally", "and", "misunderstanding"]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n))
    rows, bare = [], {}
    for i in range(600):
        text = prose(30)
        if i % 3 == 0:
            text += f' {pick.choice(["password", "api_key", "secret"])} = "{value(32)}" '
        elif i % 20 == 1:
            bare[i] = value(32)
            text += f" see {bare[i]} for {prose(3)}"
        rows.append((i, text + prose(20)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), bare


def test_network_finds_values_without_a_key(spark, labelled):
    docs, bare = labelled
    net = secret_cnn.train(docs)
    assert 0 < net.threshold < 1
    rows = {r.doc_id: r for r in secret_cnn.findings(docs, net).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = {i: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("model")] for i, r in rows.items()}
    right = sum(any(texts[i][a:b] == v for a, b in model[i]) for i, v in bare.items())
    wrong = sum(texts[i][a:b] not in bare.values() for i, spans in model.items() for a, b in spans)
    assert right >= 0.8 * len(bare) and wrong <= 3
    for i, r in rows.items():
        assert [x for x in r.spans.split(",") if x and not x.startswith("model")] == [x for x in r.base_spans.split(",") if x]
    again = secret_cnn.train(docs.repartition(7))
    assert again.threshold == net.threshold and np.array_equal(again.w["conv"], net.w["conv"])


def test_every_finding_is_learned_or_calibrates(spark, labelled, monkeypatch):
    """No sample: each distinct candidate is learned in a shard or counted, whatever the number of shards."""
    docs, bare = labelled
    want = set()
    for _, _, data, offsets in secret_cnn.runs(pa.array([r.text for r in docs.collect()])):
        scan = secret_cnn.Scan(data, offsets)
        want |= set(zip(scan.windows(), (scan.kind >= 0).tolist(), strict=True))
    found = secret_cnn.labelled(docs)
    assert {(bytes(r.bytes), r.secret) for r in found.collect()} == want and found.count() == len(want) > 2 * 1_500
    counted = []
    monkeypatch.setattr(secret_cnn, "fitted", lambda net, margin, kind, count, recall, real=secret_cnn.fitted: counted.append(count.sum()) or real(net, margin, kind, count, recall))
    net = secret_cnn.train(docs, shard=2_000)
    assert counted == [found.filter("apart").count()]
    learned = secret_cnn.dealt(found.filter("not apart"), 4, {True: 3, False: 1}).groupBy("mark", "secret").count()
    assert learned.count() == found.filter("not apart").count()
    assert {(r.secret, r["count"]) for r in learned.select("secret", "count").distinct().collect()} == {(True, 3), (False, 1)}
    spans = {r.doc_id: r.spans for r in secret_cnn.findings(docs, net).collect()}
    assert sum("model" in spans[i] for i in bare) >= 0.8 * len(bare) and sum("model" in x for i, x in spans.items() if i not in bare) <= 3


def test_recall_of_every_kind_is_kept():
    rng = random.Random(1)
    windows = [bytes(rng.choice(b"abcdef0123456789") for _ in range(60)) for _ in range(60)] + [b"plainwords" * 6] * 60
    kind = np.array([0, 1, 2] * 20 + [-1] * 60)
    net = secret_cnn.learn(windows, (kind >= 0).astype(np.float32))
    secret_cnn.calibrate(net, windows, kind, recall=0.9)
    score = net.score(windows)
    assert all((score[kind == k] >= net.threshold).mean() >= 0.9 for k in range(3)) and (score[kind < 0] < net.threshold).all()
    order = np.argsort(net.margin(windows))
    assert (np.diff(score[order]) >= 0).all()


def test_blocks_do_not_change_a_score(monkeypatch):
    net = secret_cnn.learn([b"a" * 60, b"7" * 70, b"b" * 60, b"9x" * 40] * 8, np.array([0, 1, 0, 1] * 8, np.float32))
    windows = [b"q7" * 500, b"\0" * 20 + b"password" + b"\0" * 20, b"z" * 41, "é日".encode() * 30]
    want = net.score(windows)
    monkeypatch.setattr(secret_cnn, "BLOCK", 64)
    assert np.allclose(net.score(windows), want, atol=1e-5)
    data, part, segment = secret_cnn.positions(windows)
    for i, w in enumerate(windows):
        for p in range(3):
            own = data[(segment == 3 * i + p) & (part == p + 1)].tobytes()
            assert own == (w[:20], w[20:-20], w[-20:])[p]


def test_redaction(spark):
    docs = secret_docs(spark)
    out = {r.doc_id: r.text for r in secret_cnn.redacted(docs, secret_cnn.Network({})).collect() if r.doc_id is not None}
    assert out[0] is None and out[3] == "[secret]" and out[21] == "日本[secret]語" and out[9].startswith("é日 [secret]")
    assert out[18] == "[secret]"  # hex inside the value of an assignment is one span with it
    assert secret_cnn.redacted(docs, secret_cnn.Network({})).schema == docs.schema


def test_no_labels_no_model(spark):
    docs = spark.createDataFrame([(1, "nothing of the kind in here"), (2, None)], "doc_id int, text string")
    assert secret_cnn.train(docs).threshold == float("inf") and secret_cnn.train(docs.limit(0)).threshold == float("inf")


def test_registered_secrets(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_secrets(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [want.count(k) for k in secret_cnn.KINDS[:3]]


# Filter audit


def fails(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller]


def simple_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = [(i, p or "", fails(t or "", i is not None and first[t or ""] < i)) for i, t, p in docs]
    out = {}
    for part in {p for _, p, _ in rows}:
        own = [(i, f) for i, p, f in rows if p == part]
        total = Counter()
        for order in permutations(range(5)):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                before = [f for j, f in own if any(f[y] for y in order[: step - 1])]
                left = [(i, f) for i, f in left if not f[x]]
                total[x] += len(gone)
                out[part, "".join("ABCDE"[y] for y in order), step] = [
                    len(left), len(gone), sum(f[x] for f in before), sum(f[x] and sum(f) == 1 for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total["ABCDE".index(order[step - 1])])
    return out


def audit_docs():
    pick = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(pick.sample(words, pick.choice([20, 120]))), pick.choice(["en", "de", None])) for i in range(40)]
    docs += [(40 + i, docs[i % 6][1], pick.choice(["en", "fr"])) for i in range(20)]
    docs += [(70, None, "en"), (71, "", "en"), (72, " \t\n", "en"), (73, "A B " * 80, "en"), (74, "É# " * 120, "de"), (75, "x " * 50_000, "de"), (76, "A" * 10 + "é" * 90, "de")]
    docs += [(3, docs[3][1], "fr"), (3, docs[3][1], docs[3][2]), (None, docs[3][1], "en"), (None, "only nameless", None), (None, "only nameless", None)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 76, 3)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = audit_docs()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("mask", F.lit(7)).withColumn("part", F.lit("z")).withColumn("n", F.lit(1))
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("lang", F.lit("no"))
    rows = filter_lattice.audit(frame, known).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in filter_lattice.COUNTS] + [r.shapley] for r in rows} == simple_audit(docs, labels)
    assert len(rows) == 600 * 4
    assert filter_lattice.audit(frame.limit(0), known).count() == 0
    assert filter_lattice.audit(frame, known.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
    shares = {(r.part, r.filter): r.share for r in filter_lattice.share_report(frame, known).collect()}
    assert shares["en", "A"] == next(r.shapley for r in rows if r.part == "en" and r.filter_order[r.step - 1] == "A") / 120


def test_path_counts():
    forward, backward = filter_lattice.path_counts(4)
    for state in range(16):
        orders = [o for o in permutations(range(4)) if {f for f in range(4) if state >> f & 1} == set(o[: state.bit_count()])]
        assert forward[state] * backward[state] == len(orders)


# Hard negatives


def simple_negatives(rows, is_anchor, positives=5, negatives=3):
    known = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        if i not in known or (label, q) > known[i]:
            known[i] = (label, q)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (la, qa) in known.items():
        if not is_anchor(a):
            continue
        scored = [(-dot(qa, q), i, label) for i, (label, q) in known.items() if i != a]
        for p, i, _ in sorted(x for x in scored if x[2] == la)[:positives]:
            fit = sorted((s, j) for s, j, label in scored if label != la and 50 * -p <= 100 * -s <= 95 * -p)
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def vectors(seed, n=700, d=24, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.4, (labels, d))
    label = rng.integers(0, labels, n)
    v = (centre[label] + rng.normal(0, 0.3, (n, d))).astype(np.float32)
    v[::9] = v[0]  # ties over labels
    rows = [(i, int(c), [float(x) for x in v[i]]) for i, c in enumerate(label)]
    rows += [(None, 1, rows[0][2]), (9001, None, rows[0][2]), (9002, 1, None), (9003, 1, [None, 1.0]), (9004, 1, [float("nan")]), (9005, 1, [float("inf")])]
    rows += [(10, 0, rows[5][2]), (10, 0, rows[5][2]), (9006, 1, []), (9050, 1, rows[1][2][:7]), (9100, 77, rows[1][2]), (9150, 2, rows[3][2] + [0.5, -0.25])]
    return rows


SCHEMA = "vec_id bigint, label int, embedding array<float>, id string, q int, score int"


@pytest.mark.parametrize(("seed", "block_bytes"), [(1, 8 << 20), (2, 600)])
def test_negatives_equal_brute_force(spark, seed, block_bytes):
    rows = vectors(seed)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    got = segment_negatives.mine(frame, F.col("id") % 50 == 0, block_bytes=block_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == simple_negatives(rows, lambda i: i % 50 == 0)
    assert segment_negatives.mine(frame.limit(0), F.col("id") % 50 == 0).count() == 0
    assert segment_negatives.mine(frame.filter("label = 77"), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("scale", [1, 2**20, 2**44])
def test_scores_are_exact_at_every_size(scale):
    """float32, float64 and whole-number products all give the exact score of every pair left."""
    rng = np.random.default_rng(4)
    q = rng.integers(-9, 9, (60, 32)) * int(scale**0.5)
    all_ = segment_negatives.Vectors(np.arange(60), np.zeros(60, np.int64), q.astype(np.int64))
    some = segment_negatives.Vectors(np.arange(60), np.ones(60, np.int64), q[::-1].astype(np.int64).copy()).ready()
    true = q.astype(object) @ q[::-1].T.astype(object)
    least = np.sort(true, axis=0)[-4].astype(np.int64)
    r, a, score = segment_negatives.surviving(all_, some, np.ones((60, 60), bool), least, np.full(60, np.inf), 0)
    assert all(true[i, j] == s for i, j, s in zip(r, a, score, strict=True))
    want = {(i, j) for i in range(60) for j in range(60) if true[i, j] >= least[j]}
    assert want <= set(zip(r.tolist(), a.tolist(), strict=True))


def test_bounds_hold_and_prune():
    """On clustered vectors the coarse bounds leave a small share of the pairs for exact scores."""
    rng = np.random.default_rng(5)
    level = np.repeat(rng.normal(0, 200, (400, 4)), 16, axis=1)
    q = (level + rng.normal(0, 8, (400, 64))).astype(np.int64)
    v = segment_negatives.Vectors(np.arange(400), np.zeros(400, np.int64), q).ready()
    true = q @ q.T
    least = np.sort(true, axis=0)[-5]
    r, a, _ = segment_negatives.surviving(v, v, np.ones((400, 400), bool), least, np.full(400, np.inf), 0)
    assert len(r) < 0.05 * true.size
    assert np.count_nonzero(true >= least[None]) == sum(true[i, j] >= least[j] for i, j in zip(r, a, strict=True))
    for length in segment_negatives.LENGTHS:
        m, s = v.segments(length)
        assert (np.abs(true - m @ m.T) <= s @ s.T + 1e-4 * np.abs(true).max()).all()


def test_best_keeps_ties_by_key():
    best = segment_negatives.Best(2, 2)
    best.add(np.array([0, 0, 1]), np.array([5, 7, 1]), np.array([9, 8, 7]))
    best.add(np.array([0, 0]), np.array([7, 7]), np.array([3, 11]))
    assert list(zip(best.group.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == [(0, 7, 3), (0, 7, 8), (1, 1, 7)]
    assert best.least().tolist() == [7, segment_negatives.NONE]


def test_window_limits():
    for p in (-7, -1, 0, 1, 3, 10, 101, 65_537):
        low, high = (int(x[0]) for x in segment_negatives.limits(np.array([p]), 50, 95))
        assert [n for n in range(-200, 70_000) if 50 * p <= 100 * n <= 95 * p] == list(range(low, high + 1))


def test_counts_by_anchor(spark):
    """Every anchor has at most five positives of three negatives each, in rank order."""
    rows = queries.op13_hard_negatives(spark, "/root/testdata/sf0.01").collect()
    each = defaultdict(list)
    for r in rows:
        each[r.anchor_id, r.positive_id].append((r.rank, -r.negative_score, r.negative_id))
    assert rows and all(sorted(x)[0][0] == 1 and sorted(x) == [(i, *y[1:]) for i, y in enumerate(sorted(x, key=lambda y: y[1:]), 1)] for x in each.values())
    assert max(Counter(a for a, _ in each).values()) <= 5

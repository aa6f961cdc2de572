"""Every operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratiform.llm import attention_lm, debruijn, decontaminate, genetic_packing, license_ac, line_rules, near_jaccard, quality_fm, queries, simhash_vp, url_gbt, warc_bundles
from stratiform.llm.words import Words

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, spans int, hits int, fp int, row string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) if n else ""


@pytest.fixture(scope="module")
def texts():
    shared = prose(99, 60)
    out = {i: prose(i, 40 + i) for i in range(20)}
    out |= {20: None, 21: "", 22: " \n\t", 23: out[3], 24: out[3] + " omega", 25: f"{out[5]} {shared}", 26: f"{shared}\n{out[6]}", 27: f"{shared} {shared}", 28: prose(28, 30_000), 29: "one", 30: "ONE", 31: "É ß 日本 x\x00y   z"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t), "k", 1, 2, 3, "r") for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[4], (None, texts[7], None, None, None, None, None, None, None, None)], SCHEMA)


def by_id(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def spaced(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_quality(spark, docs, texts):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(20)] + [(None, 1), (3, None), (4, 1)], "doc_id bigint, quality int")
    machine = quality_fm.train(docs, labels, metadata=["n_chars"])
    rows = quality_fm.scores(docs, machine, metadata=["n_chars"]).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_fm.keep_good(docs, machine, metadata=["n_chars"]).columns == docs.columns
    none = quality_fm.train(docs, labels.limit(0))
    assert {r.score for r in quality_fm.scores(docs, none).collect()} == {0.5}
    assert quality_fm.scores(docs.limit(0), none).count() == 0
    rng = np.random.default_rng(1)
    first, feature, value = np.array([0, 3, 7]), rng.integers(0, 9, 7), rng.random(7)
    m = quality_fm.Machine(0.1, rng.random(9), rng.random((9, 4)))
    for row in range(2):
        at = range(first[row], first[row + 1])
        pairs = sum(m.factors[feature[a]] @ m.factors[feature[b]] * value[a] * value[b] for a in at for b in at if a < b)
        assert m.raw(first, feature, value)[row] == pytest.approx(0.1 + sum(m.weights[feature[a]] * value[a] for a in at) + pairs)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    right = queries.op1_quality(spark, sf).filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97


def test_substrings(docs, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        w = spaced(texts[i])
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = by_id(debruijn.deduplicated(docs))
    assert len(got.pop(None)) == 1 and len(got[4]) == 2
    assert {i: (r[0].n_words, r[0].n_removed, r[0].kept_text) for i, r in got.items()} == want
    cut = debruijn.without_repeats(docs, length="n_chars")
    assert cut.schema == docs.schema and cut.count() == docs.count()
    assert debruijn.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "int"])
def test_substrings_shuffle_texts_once(spark, kind):
    """The anchors' places and the spans are joined to one and the same exchange of the texts, null keys beside it."""
    shared = prose(98, 40)
    rows = [(i, f"{prose(i, 30)} {shared}", "x") for i in range(50)] + [(None, shared, "y")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, _key string")
    for cut in (debruijn.deduplicated(docs), debruijn.without_repeats(docs)):
        found = {r.doc_id: r for r in cut.collect()}
        assert len(found) == 51 and cut.schema["doc_id"] == docs.schema["doc_id"]
        assert "ReusedExchange" in cut._jdf.queryExecution().executedPlan().toString()
    assert [found[i].text for i in (0, 1, None)] == [rows[0][1], prose(1, 30), shared]


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, None, "x"), (3, "u\r\nv", None), (4, "u", ""), (5, "u", "é" * 400_000), (6, "u", "x"), (6, "u", "x"), (None, "u", "x")], "page_id bigint, url string, html string")
    got = by_id(warc_bundles.read_bundles(*warc_bundles.write_bundles(pages, frame=1000, bundle=4000), with_payload=True), "key")
    assert [(r.record_type, r.refers_to, r.payload) for k in "12" for r in got[k]] == [("revisit", "6", b"")] * 2
    assert [r.record_type for r in got["6"]] == ["response"] * 2 and got[None][0].record_type == "response"
    assert (got["3"][0].refers_to, got["4"][0].record_type) == ("4", "response")
    assert got["5"][0].payload == ("é" * 400_000).encode() and got["5"][0].payload_bytes == 800_000
    assert got["3"][0].payload_digest == warc_bundles.payload_digest(b"") and got["3"][0].url == "u%0D%0Av"
    assert warc_bundles.read_bundles(*warc_bundles.write_bundles(pages.limit(0))).count() == 0


def test_simhash(docs, texts):
    fps = {}
    for i, t in texts.items():
        w = spaced((t or "").encode().lower().decode())
        h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 4]), 42) for j in range(max(1, len(w) - 3))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    got = by_id(simhash_vp.near_duplicates(docs))
    assert got.pop(None)[0].component_id is None
    assert {i: (r[0].fp % 2**64, r[0].component_id) for i, r in got.items()} == {i: (fps[i], root[i]) for i in fps}
    kept = simhash_vp.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*set(root.values()), None])
    assert simhash_vp.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [0, 5])
def test_vantage_points_lose_no_link(depth):
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, 300, np.uint64)
    near = fp[:150].copy()
    for i in range(150):
        for b in rng.choice(64, i % 7, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    fp = np.unique(np.concatenate([fp, near]))
    label = np.arange(len(fp))
    shards = defaultdict(list)
    for node, at, home in simhash_vp.routes(fp, depth, 4):
        for n, a, h in zip(node, at, home, strict=True):
            shards[n].append((a, h))
    for members in shards.values():
        at, home = np.array([a for a, _ in members]), np.array([h for _, h in members])
        local = simhash_vp.link_shard(fp[at], home, 4, leaf=4)
        simhash_vp.join_labels(label, at, at[local])
    want = np.arange(len(fp))
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    simhash_vp.join_labels(want, x, y)
    assert np.array_equal(label, want)


def test_near_copies_of_the_pipeline(spark):
    """One to four words changed in documents of 100: links against brute force over all pairs."""
    rng, rows = np.random.default_rng(12), []
    for i in range(150):
        words = rng.integers(0, 5_000, 100).astype(str)
        for changed in range(4):
            copy = words.copy()
            copy[rng.choice(100, changed, replace=False)] = [f"new{i}x{changed}x{j}" for j in range(changed)]
            rows.append((4 * i + changed, " ".join(copy)))
    sets = {i: {tuple(t.split()[s : s + 5]) for s in range(96)} for i, t in rows}
    similar = {(a, b) for a in sets for b in sets if a < b and a // 4 == b // 4 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {r.doc_id: r.component_id for r in near_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    linked = sum(found[a] == found[b] for a, b in similar)
    assert len(similar) > 200 and linked >= 0.99 * len(similar)
    # nothing is linked that no chain of similar pairs links
    label = np.arange(len(rows))
    pairs = np.array(sorted(similar))
    simhash_vp.join_labels(label, pairs[:, 0], pairs[:, 1])
    assert all(label[i] == label[c] for i, c in found.items())


def test_trees_name_candidates_of_the_pipeline(spark, monkeypatch):
    """Without a MinHash fingerprint shared, the vantage-point trees alone find close copies; unlike texts of one fingerprint stay apart."""
    rng, rows = np.random.default_rng(14), []
    for i in range(20):
        words = rng.integers(0, 5_000, 400).astype(str)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, f"new{i}"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in simhash_vp.fingerprints(docs, shingle=near_jaccard.SHINGLE).collect()}
    close = {i for i in range(20) if (fp[2 * i] ^ fp[2 * i + 1]).bit_count() <= simhash_vp.RADIUS}
    assert len(close) > 10
    monkeypatch.setattr(near_jaccard, "marks", lambda *a, real=near_jaccard.marks: real(*a).withColumn("bands", F.array(F.col("whole"))))
    found = {r.doc_id: r.component_id for r in near_jaccard.near_duplicates(docs).collect()}
    assert all((found[2 * i + 1] == 2 * i) == (i in close) for i in range(20))
    # a candidate below the similarity is not linked
    monkeypatch.setattr(near_jaccard, "tree_pairs", lambda *a: spark.createDataFrame([(1, 0), (2, 0), (7, 5)], "a bigint, b bigint"))
    found = {r.doc_id: r.component_id for r in near_jaccard.near_duplicates(docs).collect()}
    assert found == {i: 0 if i == 1 else i for i in range(40)}


def test_hub_families_of_the_pipeline(spark):
    """Copies that are similar to one hub and hardly to each other: the same components as all pairs give."""
    rng, rows = np.random.default_rng(13), []
    for family in range(3):
        hub = rng.integers(0, 5_000, 220).astype(str)
        for i in range(24):
            copy = hub.copy()
            copy[rng.choice(np.arange(5, 215), 3, replace=False)] = [f"new{family}x{i}x{j}" for j in range(3)]
            rows.append((100 * family + i, " ".join(copy)))
        rows.append((100 * family + 99, " ".join(hub)))
    sets = {i: {tuple(t.split()[s : s + 5]) for s in range(216)} for i, t in rows}
    ids = sorted(sets)
    x, y = np.nonzero([[len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in ids] for a in ids])
    label = np.arange(len(ids))
    simhash_vp.join_labels(label, x, y)
    found = {r.doc_id: r.component_id for r in near_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {i: ids[label[j]] for j, i in enumerate(ids)}
    assert len(set(found.values())) == 3


def test_licenses(spark, docs):
    rows = [(1, "MIT License mit license; GNU General Public License"), (2, "cc"), (3, "by the"), (4, "// SPDX-License-Identifier: (MIT OR GPL-2.0) AND Apache-2.0\nx"), (5, "SPDX-License-Identifier: MIT OR"), (6, None)]
    got = {r.doc_id: r for r in license_ac.licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 4, "gpl,mit")
    assert got[2].n_base == got[3].n_base == 0  # no phrase over two rows
    assert got[4].labels == "apache-2.0,gpl-2.0,mit" and got[4].score == 0.9
    assert got[5].labels == "" and got[6].n_words == 0 and got[6].score == 0
    assert license_ac.evaluate("mit or gpl-3.0 and apache-2.0")[1] == 0.95
    assert license_ac.evaluate("gpl-2.0 with classpath-exception-2.0") == ({"gpl-2.0-with-classpath-exception-2.0"}, 0.4)
    assert all(license_ac.evaluate(x) is None for x in ("mit mit", "(mit", ")", "mit or", "mit with (a or b)", "mit & b"))
    assert license_ac.licenses(docs).count() == docs.count()


def test_scores(docs, texts):
    train = F.col("doc_id") % 3 != 0
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = by_id(attention_lm.scores(docs, train, vocabulary))
    tokens = {i: [*spaced((t or "").encode().lower().decode()), None] for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if i % 3 for w in t) + Counter(tokens[4])  # document 4 is there twice
    n, v = sum(counts.values()), len(counts)
    assert len(got.pop(None)) == 1
    for i, t in tokens.items():
        r = got[i][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.score < 0
    assert attention_lm.scores(docs.limit(0), train, vocabulary).count() == 0


def test_windows_score_each_id_once():
    n = np.array([1, 32, 33, 200, 56, 57])
    *_, at, there, scored = attention_lm.windows(np.zeros(n.sum(), int), n)
    assert np.array_equal(np.sort(at[scored]), np.arange(n.sum())) and not (scored & ~there).any()


def test_attention_gradients():
    rng = np.random.default_rng(0)
    m = {k: w.astype(float) for k, w in attention_lm.draw().items()}
    x, y = rng.integers(0, attention_lm.CLASSES, (2, 3, attention_lm.SPAN))
    loss = lambda m: -np.take_along_axis(attention_lm.forward(m, x)[0], y[..., None], 2).mean()
    g = attention_lm.gradients(m, x, y, np.ones(x.shape, bool))
    for name in m:
        at = (int(x[0, 0]), 0) if name == "emb" else (0,) * m[name].ndim
        up, down = ({k: w.copy() for k, w in m.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=0.01, abs=1e-5)


def test_attention_scores_agree_with_layer():
    """Scoring by tables and buffers gives what the layer gives, for full and short batches and large weights."""
    rng = np.random.default_rng(1)
    for size, scale in ((attention_lm.BATCH, 1), (3, 1), (5, 8)):
        m = {k: w * np.float32(scale) for k, w in attention_lm.draw().items()}
        x, y = rng.integers(0, attention_lm.CLASSES, (2, size, attention_lm.SPAN))
        scorer = attention_lm.Scorer(m, np.arange(attention_lm.CLASSES), np.ones(attention_lm.CLASSES))
        want = np.take_along_axis(attention_lm.forward(m, x)[0], y[..., None], 2)[..., 0]
        assert np.allclose(scorer.targets(x, y, scorer.buffers()), want, atol=1e-4)


def test_attention_learns_where_it_scores(monkeypatch):
    """States, logits and the way back are made of scored places alone, and the gradients are those of whole windows."""
    rng, span, half = np.random.default_rng(2), attention_lm.SPAN, attention_lm.OVERLAP
    m, low = {k: w.astype(float) for k, w in attention_lm.draw().items()}, half
    x = rng.integers(0, attention_lm.CLASSES, (5, span))
    whole, part = attention_lm.attend(m, x), attention_lm.attend(m, x, low)
    assert np.allclose(whole[-1][:, low:], part[-1])
    dh = rng.normal(size=whole[-1].shape)
    dh[:, :low] = 0
    (g, de), (h, df) = attention_lm.attend_back(m, 0, whole, dh), attention_lm.attend_back(m, low, part, dh[:, low:])
    assert np.allclose(de, df) and all(np.allclose(g[n], h[n]) for n in g)
    n = np.array([200, 7, 1, 90, 40])
    x, y, _, _, scored = attention_lm.windows(rng.integers(0, 500, n.sum()), n)
    places, states, back, attend = [], [], attention_lm.told_back, attention_lm.attend
    monkeypatch.setattr(attention_lm, "told_back", lambda full, ends, *more: [places.append((len(full), ends.shape[1])), back(full, ends, *more)][1])
    monkeypatch.setattr(attention_lm, "attend", lambda m, x, low=0: [states.append(x.shape[0] * (x.shape[1] - low)), attend(m, x, low)][1])
    training = attention_lm.Training(attention_lm.draw(500), attention_lm.Groups(np.ones(500)), 0.003, 64)
    training.learn(x, y, scored)
    assert [k for k, c in places if c == attention_lm.CLASSES] == [n.sum()] and sum(states) <= n.sum() + len(n) * half
    assert training.read.sum() == x.size


def test_states_of_any_length_have_right_gradients():
    """With logits far beyond what exponentials hold, too."""
    rng = np.random.default_rng(4)
    for scale in (0.1, 30):
        h, ends, own = rng.normal(0, scale, (700, attention_lm.WIDTH)), rng.normal(0, scale, (attention_lm.WIDTH + 1, 9)), rng.integers(0, 9, 700)
        full, length = attention_lm.with_one(h), attention_lm.longest(h)
        z = full @ ends
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        some = p.min(1) > 1e-30
        assert np.allclose(attention_lm.told(full, ends, own, length)[some], np.log(p[some, own[some]]), rtol=1e-4, atol=1e-4)
        p[np.arange(700), own] -= 1
        g, dh = attention_lm.told_back(full, ends, own, length, 0.5)
        assert np.allclose(g, full.T @ p / 2) and np.allclose(dh, p @ ends[:-1].T / 2)


def test_subwords_tokenize_a_word_once(monkeypatch):
    """Words beyond 200,000 stay known, for all tasks of a worker; odd words have the ids they have alone."""
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    subwords = attention_lm.subwords_of(vocabulary)
    odd = ["“hi”", "é", "日本。", "a\u00a0b", "\u00a0", "\u2003x", "...", "it's", "'s", "3.5,", "x\x00y", "\x85", "e\u0301", "<|endoftext|>", "|", "ß" * 50, "q" * 300 + ":"]
    for texts in (odd, ["", " ".join(odd), "".join(odd), "\n".join(odd[::-1])]):
        run = run_of(texts)
        ids, n = subwords.ids(run, run.hashes())
        want = [[i for w in spaced(t) for i in subwords.encoding.encode_ordinary(" " + w.decode())] + [subwords.size - 1] for t in texts]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    run = run_of([" ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(210_000))])
    first = subwords.ids(run, run.hashes())[0]
    monkeypatch.setattr(subwords, "learn", None)
    assert np.array_equal(attention_lm.subwords_of(vocabulary).ids(run, run.hashes())[0], first)


def test_attention_tells_subwords_apart(spark):
    """Each word says which comes next, among words that are all equally frequent: 0.62 of the unigrams' figure, 0.75 for classes by hash."""
    words = [f"{a}{b}" for a in ("alpha", "bravo", "delta", "gamma", "kilo", "lima", "oscar", "papa", "romeo", "tango") for b in range(10, 26)]
    after = np.random.default_rng(6).permutation(len(words))
    rows = []
    for i in range(400):
        at, text = i % len(words), []
        for _ in range(120):
            text.append(words[at])
            at = after[at]
        rows.append((i, " ".join(text)))
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = attention_lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), F.col("doc_id") % 4 != 0, vocabulary)
    score, base = found.filter("doc_id % 4 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert score > 0.7 * base


def test_every_training_window_moves_the_weights(spark):
    """An id of one training document alone has moved, wherever the document's text falls; so has one far into a long text."""
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = [(i, prose(i, 200)) for i in range(400)] + [(400, prose(400, 20_000) + " zebra xylophone " + prose(401, 50))]
    docs = spark.createDataFrame(rows, "id bigint, text string").withColumn("train", F.lit(True))
    subwords = attention_lm.Subwords(*vocabulary)
    counts = np.zeros(subwords.size)
    for r in attention_lm.corpus(docs, vocabulary).filter("kind = 1").collect():
        counts[r.k] = r.v
    groups, start = attention_lm.Groups(counts), attention_lm.draw(subwords.size)
    learned = attention_lm.learned(docs, start, groups, vocabulary)
    moved = (learned["emb"] != start["emb"]).any(1)
    seen = groups.place[np.flatnonzero(counts[:-1])]  # nothing follows the end
    assert moved[seen].all() and moved[-1] and moved.sum() == len(seen) + 1
    assert [np.bincount(groups.classes)[c] for c in range(attention_lm.COMMON)] == [1] * attention_lm.COMMON
    assert np.bincount(groups.classes).sum() == subwords.size


def test_output_vectors_learn_by_their_gradient():
    """A step goes down the whole loss: class and subword among its class."""
    rng = np.random.default_rng(7)
    groups = attention_lm.Groups(rng.integers(0, 50, 3_000).astype(float))
    x, y = rng.integers(0, 3_000, (2, 4, attention_lm.SPAN))
    scored = np.ones(x.shape, bool)
    training = attention_lm.Training(attention_lm.draw(3_000), groups, 0.003, 64)
    n = np.full(4, attention_lm.SPAN)

    def loss():
        scorer = attention_lm.Scorer(training.m, groups.classes, groups.counts)
        return -scorer.score(y.ravel(), n).sum()

    x, y = attention_lm.windows(y.ravel(), n)[:2]
    before = loss()
    m, share = training.m, attention_lm.Members(groups.classes, groups.counts)
    z, *_, h = attention_lm.forward(m, x)
    want = np.take_along_axis(z, groups.classes[y][..., None], 2)[..., 0] + share.logs[y]  # output vectors are still 0
    assert before == pytest.approx(-want.sum() / np.log(10), rel=1e-4)
    for _ in range(60):
        training.learn(x, y, scored)
    assert loss() < 0.6 * before


def test_urls(spark):
    rows = [(1, "http://A.example.NET/en/x?y=1"), (2, "http://net/q"), (3, None), (4, "nothing"), (5, "https://x.example.com/de/1#a"), (6, "http://fr.org/fr/"), (7, "http://fr.org"), (8, "http://internet/x"), (8, "http://internet/x")]
    got = by_id(url_gbt.judge(spark.createDataFrame(rows, "page_id bigint, url string")), "page_id")
    assert [(got[i][0].host, got[i][0].path, got[i][0].rule) for i in range(1, 9)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("net", "/q", "net/"), ("", "", None), ("", "", None),
        ("x.example.com", "/de/1", "example.com/de/"), ("fr.org", "/fr/", "org/fr/"), ("fr.org", "", None), ("internet", "/x", None),
    ]
    assert [got[i][0].verdict for i in (1, 2, 5, 6)] == ["allow", "block", "block", "allow"]
    assert len(got[8]) == 2 and {r.verdict for x in got.values() for r in x} <= {"allow", "block"}
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert url_gbt.judge(empty).count() == 0


def test_line_rules(docs, texts):
    got = by_id(line_rules.with_rules(docs))
    for i, t in texts.items():
        w, covered = spaced(t), set()
        windows = Counter(tuple(w[s : s + 5]) for s in range(len(w) - 4))
        for s in range(len(w) - 4):
            if windows[tuple(w[s : s + 5])] > 1:
                covered.update(range(s, s + 5))
        lines = [x for x in (t or "").split("\n") if spaced(x)]
        r = got[i][0]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) == (len(w), len(covered), len(lines) - len(set(lines)), sum(len(x.decode()) for x in w))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)


def test_packing(docs, texts):
    tokenizer = Tokenizer.from_file(PATH)
    rows = genetic_packing.packed(docs, PATH).collect()
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
        assert sorted(got[i]) == sorted(want * (2 if i == 4 else 1))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1 + math.ceil(sum(r.length for r in rows) / 4096)
    assert genetic_packing.packed(docs.limit(0), PATH).count() == 0


def run_of(texts):
    rows = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]), genetic_packing.INSIDE)


def test_packing_tokenizes_a_word_once(monkeypatch):
    """Words beyond 300,000 stay known, in other cases and with other marks too; tasks of a worker share them."""
    tokenize = genetic_packing.word_tokenizer(PATH)
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(310_000)]
    flat, n = tokenize.ids(run_of([" ".join(names)]))
    asked = []
    encode = tokenize.encode
    monkeypatch.setattr(tokenize, "encode", lambda texts: [asked.extend(texts), encode(texts)][1])
    again, m = genetic_packing.word_tokenizer(PATH).ids(run_of([" ".join(names[:200_000]), " ".join(names[200_000:])]))
    assert not asked and np.array_equal(flat, again) and n.sum() == m.sum()
    tokenize.ids(run_of([" ".join(x.title() + "." for x in names[:1000])]))
    assert set(asked) <= {".", ""}


def test_packing_ids_of_odd_words():
    odd = ["Éa", "İstanbul,", "日本。", "слово.", "ΑΣ.", "e\u0301e!", "a\u00a0b", "\u00a0", "...", "it's", "3.5,", "x\x00y", "“Hi”", "ABC!?", "𝒜x", "<|endoftext|>", "", "a.b", ".a", "ß" * 50, "q" * 300 + ":"]
    texts = [*odd, " ".join(odd), "".join(odd), "\n".join(reversed(odd))]
    tokenize, library = genetic_packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        flat, n = tokenize.ids(run_of(texts))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    tokenize.known.limit = 5  # a full cache begins anew
    assert tokenize.ids(run_of(texts[::-1]))[0].tolist() == [i for x in want[::-1] for i in x]


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 90, 300).tolist()
    a = genetic_packing.Packing(sizes, genetic_packing.from_numbers(genetic_packing.evolve(sizes, [], 1, 100)), 100)
    b = genetic_packing.Packing(sizes, [[i] for i in range(300)], 100)
    child = genetic_packing.mutate(sizes, genetic_packing.crossover(sizes, a, b, rng, 100), rng, 100)
    assert sorted(i for x in child.bins for i in x) == list(range(300)) and max(child.fill) <= 100


@pytest.mark.parametrize("limit", [decontaminate.BLOCK, 7])
def test_decontamination(spark, docs, texts, limit):
    bench = spark.createDataFrame([(1, " ".join(texts[8].split()[3:30]).upper()), (2, "日本"), (3, None), (10, texts[8]), (None, "zzz")], "item_id bigint, text string")
    alnum = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    items = [(str(r.item_id), alnum(r.text)) for r in bench.collect() if r.item_id is not None]
    got = by_id(decontaminate.contamination(docs, bench, limit=limit))
    for i, t in texts.items():
        w, hit, found = alnum(t), set(), set()
        for item, b in items:
            k = min(10, len(b))
            grams = {tuple(b[s : s + k]) for s in range(len(b) - k + 1)} if b else set()
            for s in range(len(w) - k + 1) if b else ():
                if tuple(w[s : s + k]) in grams:
                    hit.update(range(s, s + k))
                    found.add(item)
        assert (got[i][0].n_words, got[i][0].n_hit, got[i][0]["items"]) == (len(w), len(hit), sorted(found))
    dropped = decontaminate.clean(docs, bench, limit=limit)
    assert dropped.columns == docs.columns and not {8, 31} & {r.doc_id for r in dropped.collect()}
    spans = by_id(decontaminate.clean(docs, bench, mode="spans", limit=limit))
    assert spans[8][0].text.strip() == "" and spans[9][0].text == texts[9]
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_pipeline(spark, tmp_path, docs, texts):
    """Every stage against what it should keep, on rows with clashing columns."""
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[9])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in range(5)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != "packing":
            assert frame.columns == docs.columns
            frame = corpus_pipeline.stored(frame, name)
        ids = {r.doc_id for r in frame.select("doc_id").collect()}
        if name == "near_duplicates":
            assert not {23, 30} & ids and {3, 0, 25, None} <= ids
        if name == "repeated_spans":
            kept = {r.doc_id: r for r in frame.collect()}
            # 25 is document 5 and a passage, 26 that passage and document 6
            assert (kept[25].text, kept[26].text) == (prose(99, 60), "") and kept[25].n_chars == len(kept[25].text)
        if name == "benchmark_decontamination":
            assert 9 not in ids and 10 in ids
    assert {"piece", "sequence_id", "offset"} <= set(frame.columns)

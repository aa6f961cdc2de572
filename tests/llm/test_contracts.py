"""Columns that the contracts fix, against plain Python over the whole small tables and over hard rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratiform.llm import license_ac, near_jaccard, queries, url_gbt

SF = "/root/testdata/sf0.001"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held_out(key, folds):
    return zlib.crc32(str(key).encode()) % folds == 0


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def licence_base(text):
    words = ALNUM.findall(low(text))
    found = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    starts = [i for i, _ in found]
    labels = ",".join(sorted({x for _, x in found}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), labels


HARD = [
    None, "", "MIT\nLicense", "mit licenses", "amit license", "CC-BY cc by CC  BY", "cc byé cc", "GNU General Public License Apache License, mit license MIT",
    "É" * 50_000 + " mit license", "the gnu general public license gnu general public license", "cc by " * 3_000, "mit", "license mit", "mit7 license",
]


def test_licence_places(spark, documents):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(HARD)], "doc_id bigint, text string, labels string, n_words int")
    rows = {r.doc_id: r for r in license_ac.licenses(docs.unionByName(docs)).collect()}
    whole = {r.doc_id: r for r in queries.op5_licenses(spark, SF).collect()}
    assert len(rows) == len(HARD) and whole.keys() == documents.keys()
    for r, text in [(rows[i], t) for i, t in enumerate(HARD)] + [(whole[i], t) for i, t in documents.items()]:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licence_base(text), r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_ac.licenses(docs.limit(0)).count() == 0


def url_base(url):
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", "", None
    host = re.split("[/?#]", rest[2], maxsplit=1)[0]
    path = re.split("[?#]", rest[2][len(host) :], maxsplit=1)[0]
    host = low(host)
    fits = []
    for rule in RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith(f".{name}")) and path.startswith(f"/{start}"):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme/net", "http://", "http://net", "http://net/", "HTTP://Example.NET/en/", "http://example.net/EN/", "http://a.b.example.net/en/x?y#z",
    "http://notexample.net/en/", "http://x.org/fr/", "http://x.org/fr", "http://example.com?de/", "http://example.com/de/#f", "http://example.com#/de/", "a://b://c.net/x",
    "http://É.net/", "http://x.com/" + "a" * 100_000, "http://net?x://y", "http://.net/", "http://netorg/fr/", "http://u@example.com:80/de/",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "<html>", "h") for i, u in enumerate(URLS)], "page_id bigint, url string, html string, host string")
    own = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = [(r, URLS[r.page_id]) for r in url_gbt.judge(pages.unionByName(pages)).collect()]
    whole = queries.op7_urls(spark, SF).collect()
    assert len(rows) == 2 * len(URLS) and len(whole) == len(own)
    for r, url in rows + [(r, own[r.page_id]) for r in whole]:
        assert (r.host, r.path, r.rule) == url_base(url), url
        assert r.verdict == RULES[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert url_gbt.judge(pages.limit(0)).count() == 0


def test_quality_columns(spark, documents):
    rows = {r.doc_id: r for r in queries.op1_quality(spark, SF).collect()}
    assert rows.keys() == documents.keys()
    for i, r in rows.items():
        assert r.held_out == held_out(i, 5) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_language_model_base_score(spark, documents):
    tokens = {i: [*SPACED.findall(low(t)), None] for i, t in documents.items()}
    counts = Counter(x for i, ts in tokens.items() if not held_out(i, 10) for x in ts)
    n, v = sum(counts.values()), len(counts)
    for r in queries.op6_lm(spark, SF).collect():
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id, 10), len(own), sum(counts[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_packing_pieces(spark, documents):
    """Every document in pieces of at most 4096 tokens, every sequence gapless from 0."""
    rows = queries.op9_packing(spark, SF).orderBy("sequence_id", "offset").collect()
    assert {r.doc_id for r in rows} == documents.keys()
    end: dict[int, int] = {}
    for r in rows:
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 4096
    pieces: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == pieces.get(r.doc_id, 0) == 4096 * r.piece
        pieces[r.doc_id] = r.start + r.length
    assert sum(pieces.values()) == sum(end.values())
    assert len(end) >= -(-sum(end.values()) // 4096)


def test_bitmaps_bound_what_documents_share(spark):
    """The bound of near duplicates never lies under the shingles shared, for sets of none to thousands."""
    rng, rows = np.random.default_rng(14), []
    for n in (0, 1, 30, 200, 3_000):
        for other in (0, 1, 40, 250):
            common = rng.integers(0, 2**63, n // 2, np.uint64)
            a, b = (np.unique(np.r_[common, rng.integers(0, 2**63, m, np.uint64)]) for m in (n - n // 2, other))
            bits = near_jaccard.bitmaps(np.r_[a, b], np.array([0, len(a), len(a) + len(b)])).view(np.int64).tolist()
            rows.append((len(a), len(b), *bits, len(np.intersect1d(a, b))))
    pairs = spark.createDataFrame(rows, "n long, n_b long, bits array<long>, bits_b array<long>, common long")
    bound = pairs.select("common", near_jaccard.most_alike("n", "bits", "bits_b").alias("x"), near_jaccard.most_alike("n_b", "bits_b", "bits").alias("y"))
    assert all(r.common <= min(r.x, r.y) for r in bound.collect())
    # unlike sets of usual sizes are ruled out
    unlike = near_jaccard.bitmaps(rng.integers(0, 2**63, 400, np.uint64), np.array([0, 200, 400])).view(np.int64).tolist()
    pair = spark.createDataFrame([(200, *unlike)], "n long, bits array<long>, bits_b array<long>")
    assert pair.select(near_jaccard.most_alike("n", "bits", "bits_b")).first()[0] < 150

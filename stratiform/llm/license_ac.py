"""Licence scan: an Aho-Corasick pass finds notice phrases and identifier tags, a shunting-yard parser reads expressions.

Phrases are looked for in the words of a text (ASCII letters, digits and non-ASCII bytes, A-Z lowered), tags such as
`SPDX-License-Identifier:` in the lowered text; what follows a tag up to the end of its line is an expression of
identifiers, AND, OR, WITH and parentheses. Labels are the base labels, those of further phrases and the identifiers
of well-formed expressions. The score is how freely the text may be used, from the most restrictive statement found:
OR takes the freer side, AND the stricter, WITH that of its licence; 0 without a statement.

One pass without a shuffle; a task holds a run of about 2 MB.

Nulls and edge cases: a null or empty text has no words, empty labels and score 0; a malformed expression adds
nothing; a phrase may not span two rows; repeated rows get the same result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.llm.frames import field
from stratiform.llm.words import LOWER, Words, runs, word_bytes

# Phrases as words, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
FURTHER = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
# How freely a text may be used, by the first matching start of an identifier.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "0bsd": 1.0, "apache": 0.9, "zlib": 0.95,
    "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-sa": 0.6, "cc-by": 0.85, "mpl": 0.7, "epl": 0.7, "lgpl": 0.65, "agpl": 0.3, "gpl": 0.4,
    "all-rights-reserved": 0.05,
}
UNKNOWN = 0.5
POWER = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"\s*(?:([()])|([a-z0-9][a-z0-9.+:-]*))")
INSIDE = word_bytes("alnum")


def freedom(name: str) -> float:
    return next((x for start, x in FREEDOM.items() if name.startswith(start)), UNKNOWN)


def tokens(text: str) -> list[str] | None:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found:
            return None
        out.append(found[1] or found[2])
        at = found.end()
    return out


def postfix(words: list[str]) -> list[str] | None:
    """Shunting-yard: operators after their operands; None if malformed."""
    out, held, operand = [], [], True
    for word in words:
        if word == "(":
            if not operand:
                return None
            held.append(word)
        elif word == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif word in POWER:
            if operand:
                return None
            while held and held[-1] != "(" and POWER[held[-1]] >= POWER[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        else:
            if not operand:
                return None
            out.append(word)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """(identifiers, freedom) of a lowered expression; None if malformed."""
    words = tokens(expression)
    order = postfix(words) if words else None
    if not order:
        return None
    stack: list[tuple[set[str], float]] = []
    for word in order:
        if word in POWER:
            right, left = stack.pop(), stack.pop()
            if word == "with":
                if len(left[0]) != 1 or len(right[0]) != 1:
                    return None
                stack.append(({f"{min(left[0])}-with-{min(right[0])}"}, left[1]))
            else:
                stack.append((left[0] | right[0], (max if word == "or" else min)(left[1], right[1])))
        else:
            stack.append(({word}, freedom(word)))
    return stack[0]


def automaton(patterns: dict[str, object]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for text, value in patterns.items():
        out.add_word(text, (len(text), value))
    out.make_automaton()
    return out


def scan_run(data: np.ndarray, offsets: np.ndarray, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> list[tuple]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of a run."""
    data = LOWER[data]
    words = Words(data, offsets, INSIDE)
    rows = len(words.n)
    base, labels, scores = [[] for _ in range(rows)], [set() for _ in range(rows)], [[] for _ in range(rows)]
    joined, place, _ = words.joined()
    # one character a byte, so that places are those of bytes
    for end, (size, (label, is_base, k)) in phrases.iter(" " + joined.decode("latin-1")):
        at = int(np.searchsorted(place, end - size + 1))
        row = words.row[at]
        if words.row[at + k - 1] == row:
            labels[row].add(label)
            scores[row].append(freedom(label))
            if is_base:
                base[row].append((at - int(words.first[row]), label))
    raw = data.tobytes()
    for end, _ in tags.iter(raw.decode("latin-1")):
        row = int(np.searchsorted(offsets, end, "right")) - 1
        stop = raw.find(b"\n", end, int(offsets[row + 1]))
        stop = int(offsets[row + 1]) if stop < 0 else stop
        found = evaluate(raw[end + 1 : stop].decode("latin-1").strip(" \t\r*/#-;"))
        if found:
            labels[row] |= found[0]
            scores[row].append(found[1])
    out = []
    for row in range(rows):
        starts = [x for x, _ in base[row]]
        out.append((int(words.n[row]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base[row]})), ",".join(sorted(labels[row])), min(scores[row], default=0.0)))
    return out


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    long = T.LongType()
    kinds = [("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]
    schema = T.StructType([field(docs, key), *(T.StructField(n, t) for n, t in kinds)])
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton({f" {p} ": (label, p in BASE, len(p.split())) for p, label in (BASE | FURTHER).items()})
        tags = automaton(dict.fromkeys(TAGS))
        for batch in batches:
            for low, high, data, offsets in runs(batch.column(1)):
                columns = zip(*scan_run(data, offsets, phrases, tags), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], names=schema.names)

    return docs.select(F.col(key), F.col(text).alias("t")).mapInArrow(run, schema)

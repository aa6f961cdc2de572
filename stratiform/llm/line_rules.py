"""Line-first quality rules, as SQL expressions alone.

Each line with a word is judged first: end punctuation, navigation (bars), symbols, shouting, one word over and over,
boilerplate phrases; a repeated line counts once. Failing lines are removed, and a document that loses more than half
of its characters is rejected, as is one that fails the base rules (too few words, too many repeated windows).

All of it happens within a row: no shuffle, no Python. A row's words are sorted once to find repeated windows, so the
cost is n log n in the words of a text.

Nulls and edge cases: a null or empty text has no words and is rejected; windows need five words; repeated rows get the
same result; other columns pass by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_LOST_PERCENT = 50
# Sets of characters and phrases.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
ENDS = r"[.!?…:;\x22'”»)\]][\x20\x09-\x0D]*\z"
BOILERPLATE = (
    "(?i)cookie policy|privacy policy|terms of (use|service)|enable javascript|all rights reserved|click here|"
    "skip to content|sign (in|up) (to|for|now)|subscribe (now|to our)|read more|lorem ipsum"
)
LINE_RULES = {"bars": 3, "symbol_percent": 10, "shout_percent": 5, "upper_percent": 60, "distinct_percent": 30, "distinct_from": 10}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words inside windows of k words that occur twice or more."""
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(
        hashed,
        lambda h: F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            ordered,
            lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])),
        )
        return let(twice, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)))


def good_line(line: Column) -> Column:
    r = LINE_RULES
    n = F.length(line)
    upper = n - F.length(F.regexp_replace(line, "[A-Z]", ""))
    lower = n - F.length(F.regexp_replace(line, "[a-z]", ""))
    varied = let(words_of(line), lambda w: (F.size(w) < r["distinct_from"]) | (100 * F.size(F.array_distinct(w)) >= r["distinct_percent"] * F.size(w)))
    return (
        line.rlike(ENDS)
        & (count_of(line, "|") < r["bars"])
        & (100 * count_of(line, SYMBOLS) <= r["symbol_percent"] * n)
        & (100 * count_of(line, "!") <= r["shout_percent"] * n)
        & (100 * upper <= r["upper_percent"] * (upper + lower))
        & ~line.rlike(BOILERPLATE)
        & varied
    )


def total_length(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))


def with_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned."""
    body = F.coalesce(F.col(text), F.lit(""))

    def judged(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(HAS_WORD))
        counts = let(words_of(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
        by_line = let(
            lines,
            lambda x: let(
                F.array_distinct(x),
                lambda d: F.struct((F.size(x) - F.size(d)).cast("bigint").alias("n_dup_lines"), total_length(x).alias("total"), F.filter(d, good_line).alias("good")),
            ),
        )
        return F.struct(
            counts.alias("c"), by_line.alias("l"), F.length(F.translate(t, SPACE, "")).cast("bigint").alias("word_chars"), count_of(t, SYMBOLS).cast("bigint").alias("n_symbols")
        )

    rows = docs.select(F.col(key), F.inline(F.array(F.struct(let(body, judged).alias("r")))))
    failed = (F.col("r.c.n_words") < MIN_WORDS) | (100 * F.col("r.c.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("r.c.n_words"))
    enough = 100 * (F.col("r.l.total") - total_length(F.col("r.l.good"))) <= MAX_LOST_PERCENT * F.col("r.l.total")
    return rows.select(
        key, F.col("r.c.n_words").alias("n_words"), F.col("r.word_chars").alias("word_chars"), F.col("r.n_symbols").alias("n_symbols"),
        F.col("r.l.n_dup_lines").alias("n_dup_lines"), F.col("r.c.n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & enough).alias("kept"), F.array_join("r.l.good", "\n").alias("cleaned"),
    )

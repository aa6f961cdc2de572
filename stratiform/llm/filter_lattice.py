"""Filter interaction audit: what each filter removes in every order of the filters, by path counts over subsets.

A state is the set of filters already applied, an edge (state, filter) applies one more. What an edge removes depends on
its state alone, not on the order in which the state was reached, so 2**(n-1) * n edges hold the steps of all n! orders.
`path_counts` counts the orders that reach a state (forward) and those that leave it for the full set (backward); an edge
lies on forward(state) * backward(state + filter) orders, which weights its removals for the Shapley sums.

Documents are reduced to a bit mask of failed conditions, then to counts by part and mask; the lattice works on those
counts alone (at most 2**n a part). Texts are read once and never shuffled. The duplicate filter needs the smallest key
of each text: rows are counted by (text digest, part, mask, labels) with map-side sums, so a text that a third of all
rows share is a few rows before its smallest key is looked for. Digests are SHA-256.

Nulls and edge cases: a null text is empty, a null part is the empty string; an empty text has no words (fails "under 100
words" only, and as a duplicate); a null key counts, but is neither smaller than another key nor has a smaller one, so it
never fails as a duplicate; repeated rows of one key are all counted and are no duplicates of each other; a key labelled
twice is good or toxic if any of its rows says so; labels without a document, or with a null key, count nowhere; an empty
table gives no rows; other columns, whatever their names, are not read. Very long texts are one row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
# by the whole text; the last letter, E, is the duplicate filter
LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For every subset of n filters: orders that lead from the empty set to it, and from it to the full set."""
    size = 1 << n
    forward, backward = [0] * size, [0] * size
    forward[0] = backward[size - 1] = 1
    for state in range(1, size):
        forward[state] = sum(forward[state ^ 1 << f] for f in range(n) if state >> f & 1)
    for state in range(size - 2, -1, -1):
        backward[state] = sum(backward[state | 1 << f] for f in range(n) if not state >> f & 1)
    return forward, backward


def text_failures(rows: DataFrame, text: str) -> DataFrame:
    """Adds `mask`: bits 0 to 3 for under 100 words, repetitive words, many capitals, symbols."""
    words = rows.withColumn("_words", F.filter(F.split(text, SPACES), lambda w: w != ""))
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), F.col(text).rlike(r"[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return words.withColumn("mask", mask).drop("_words")


def failure_counts(docs: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """Documents by part and mask: `n`, and of those `good` and `toxic`. Bit 4: the text of a smaller key."""
    slim = docs.select(F.col(key).alias("id"), F.coalesce(part, F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("t"))
    slim = text_failures(slim, "t").select("id", "part", "mask", F.unhex(F.sha2("t", 256)).alias("digest"))
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col("quality") == 1).alias("g"), F.max(F.col("toxic") == 1).alias("x"))
    said = [F.coalesce("g", F.lit(False)).alias("g"), F.coalesce("x", F.lit(False)).alias("x")]
    kinds = ["digest", "part", "mask", "g", "x"]
    by_key = slim.join(known, "id", "left").select("id", "digest", "part", "mask", *said).groupBy("id", *kinds).agg(F.count(F.lit(1)).alias("c"))
    keyed = F.when(F.col("id").isNotNull(), F.struct("id", "c"))
    by_text = by_key.groupBy(*kinds).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("nameless"), F.min(keyed).alias("first"))
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    own = F.when(F.col("first.id") == smallest, F.col("first.c")).otherwise(0)
    again = by_text.withColumn("again", F.col("n") - F.col("nameless") - own)
    copy = 1 << (len(LETTERS) - 1)
    split = F.array(F.struct(F.col("mask").bitwiseOR(copy).alias("mask"), F.col("again").alias("n")), F.struct("mask", (F.col("n") - F.col("again")).alias("n")))
    sides = again.select("part", "g", "x", F.explode(split).alias("s")).select("part", "g", "x", "s.*")
    return sides.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("g"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("x"), F.col("n")).otherwise(0)).alias("toxic")
    )


def lattice_edges(counts: DataFrame, n: int) -> DataFrame:
    """(part, state, filter) with the counts of each edge and the Shapley sum of its filter."""
    forward, backward = (F.array(*map(F.lit, x)) for x in path_counts(n))
    steps = counts.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1)))).withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    bit = F.element_at(F.array(*(F.lit(1 << f) for f in range(n))), F.col("filter") + 1)
    steps = steps.withColumn("bit", bit).filter(F.col("state").bitwiseAND(F.col("bit")) == 0)
    here, fails = F.col("mask").bitwiseAND(F.col("state")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    of = {
        "kept": (here & ~fails, "n"), "removed": (here & fails, "n"), "redundant": (~here & fails, "n"), "unique_fails": (F.col("mask") == F.col("bit"), "n"),
        "good_lost": (here & fails, "good"), "toxic_lost": (here & fails, "toxic"),
    }
    edges = steps.groupBy("part", "state", "filter", "bit").agg(*(F.sum(F.when(c, F.col(v)).otherwise(0)).alias(name) for name, (c, v) in of.items()))
    paths = F.element_at(forward, F.col("state") + 1) * F.element_at(backward, F.col("state").bitwiseOR(F.col("bit")) + 1)
    return edges.withColumn("shapley", F.sum(F.col("removed") * paths).over(Window.partitionBy("part", "filter"))).drop("bit")


def orders(letters: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, filter) of every order of the letters."""
    out = []
    for order in permutations(range(len(letters))):
        state = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(letters[i] for i in order), step, state, f))
            state |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order and step: part, filter_order, step, the counts and the Shapley sum of the step's filter."""
    edges = lattice_edges(failure_counts(docs, labels, key, text, part), len(LETTERS))
    walks = docs.sparkSession.createDataFrame(orders(LETTERS), "filter_order string, step int, state int, filter int")
    # n! * n fixed rows
    return edges.join(F.broadcast(walks), ["state", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def share_report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part and filter: Shapley share of removals (mean over all orders) and what it alone removes."""
    total = len(orders(LETTERS)) // len(LETTERS)
    edges = lattice_edges(failure_counts(docs, labels, key, text, part), len(LETTERS)).filter("state = 0")
    letter = F.element_at(F.array(*map(F.lit, LETTERS)), F.col("filter") + 1)
    return edges.select("part", letter.alias("filter"), (F.col("shapley") / total).alias("share"), "removed", "unique_fails")

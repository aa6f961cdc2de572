"""URL filter: gradient-boosted trees on lexical features, with host and path rules before them; no Python in tasks.

Rules decide the URLs they fit; these are also the labelled URLs that the trees learn from. A rule `host/path` fits its
host and all subdomains if the URL's path starts with its own; the longest wins. What no rule fits is judged by trees
over length, host length, path depth, digit ratio, entropy of the characters, number of parameters, hyphens and the
block rate and frequency of the host's suffix among the labelled URLs.

The trees are fitted on at most `MAX_TRAIN` distinct labelled URLs (of either verdict those with the smallest hash, each
weighed by its rows), the one bound here; suffix statistics cover all labelled URLs and are joined by suffix, so a busy suffix is combined before it is shuffled and its
side of the join has one row. Rules are an argument, a short list that becomes one expression.

Nulls and edge cases: a null URL or one without `://` has an empty host and path, no rule and the features of an empty
text; a suffix without labelled URLs has the overall block rate; without labelled URLs of both verdicts the method's
verdict is the more frequent one, or allow; repeated rows get the same result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 4_000
TREES, DEPTH = 16, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
FEATURES = ["length", "host_length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "suffix_rate", "suffix_count"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def lexical(host: Column, path: Column, url: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    return {
        "length": F.length(text),
        "host_length": F.length(host),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digits": (n - F.length(F.regexp_replace(text, "[0-9]", ""))) / n,
        "entropy": entropy(host),
        "parameters": F.length(text) - F.length(F.translate(text, "=&", "")),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "labels": F.size(F.split(host, r"\.")),
    }


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row a page: key, host, path, rule, verdict (that of the rule, else of the trees)."""
    host, path = parts(F.col("u"))
    rows = pages.select(F.col(key), F.col(url).alias("u")).select("*", host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r"), F.substring_index("host", ".", -1).alias("suffix"))
    labelled = rows.filter("r.verdict IS NOT NULL").withColumn("label", (F.col("r.verdict") == "block").cast("double"))
    overall = labelled.agg(F.avg("label")).first()[0]
    result = lambda df, method: df.select(key, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"))
    if overall in (None, 0.0, 1.0):
        return result(rows, F.lit("block" if overall else "allow"))

    by_suffix = labelled.groupBy("suffix").agg(((F.sum("label") + overall) / (F.count("*") + 1)).alias("rate"), F.log2(1.0 + F.count("*")).alias("seen"))

    def featured(df: DataFrame) -> DataFrame:
        df = df.join(by_suffix, "suffix", "left")
        values = lexical(F.col("host"), F.col("path"), F.col("u")) | {"suffix_rate": F.coalesce("rate", F.lit(overall)), "suffix_count": F.coalesce("seen", F.lit(0.0))}
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df.select("*", *(c.cast("double").alias(n) for n, c in values.items())))

    # a URL is one row however often it occurs, and either verdict has its share
    distinct = labelled.groupBy("u", "host", "path", "suffix", "label").agg(F.count("*").cast("double").alias("weight"))
    sides = [distinct.filter(F.col("label") == verdict).orderBy(F.xxhash64("u"), "u").limit(max_train // 2) for verdict in (0.0, 1.0)]
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11, weightCol="weight")
    model = trees.fit(featured(sides[0].unionByName(sides[1])).select("label", "weight", "features").coalesce(1))
    judged = model.transform(featured(rows))
    return result(judged, F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))

"""URL filtering by explicit list rules and mined association rules (native DataFrame code only).

A page's url is split into host and path, explicit rules (host suffix, path prefix) are applied
with the longest rule winning, and what no explicit rule decides is judged by rules that Spark's
FP-growth mines from labelled urls: token combinations whose presence implies the bad label with
enough support and confidence. A rule stands on ``min_bad`` bad pages at least, however small the table is, and its confidence is
the lower end of a 95 % interval, so a coincidence of a few pages is none. Mined rules are matched through an inverted index
keyed by each rule's rarest token.

Mined rules are worth what the labels are worth: they say where labelled pages were bad, and nothing about hosts without labels.

Defined cases: a null url, or one without ``://``, has an empty host and path, matches no rule and
has no tokens, so it is allowed. Very long urls are read whole. Of explicit rules of equal length the one that is last in
alphabetical order wins, and of mined rules of equal confidence likewise. Repeated rows are judged alike and all kept. Null labels and ids
do not take part in mining. An empty page or label table gives an empty result or no mined rules.
Columns of the inputs other than those named are ignored, also such as are named like the results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable

#: Mined rule tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_RULES = 20_000
#: Explicit rule lists up to this length become one CASE expression; longer ones an index join.
INLINE_RULES = 256


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels (h:), and path words split at punctuation (p:). All numbers are one word, as each names one page."""
    labels = F.transform(F.split(host, r"[.:@]"), lambda x: F.concat(F.lit("h:"), x))
    words = F.split(F.regexp_replace(ascii_lower(path), r"\p{N}+", "0"), r"[^\p{L}\p{N}]+")
    words = F.transform(words, lambda x: F.concat(F.lit("p:"), x))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, words), lambda x: F.length(x) > 2)))


def explicit_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict``: the longest of (verdict, host, path) rules that fits, or null."""
    fits = lambda host, path: (
        ((F.col("host") == host) | F.col("host").endswith(F.concat(F.lit("."), host))) & F.col("path").startswith(path)
    )
    if len(rules) <= INLINE_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
            rule = F.when(fits(F.lit(h), F.lit(p)), F.lit(h + p)).otherwise(rule)
            verdict = F.when(fits(F.lit(h), F.lit(p)), F.lit(v)).otherwise(verdict)
        return df.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = df.sparkSession
    table = spark.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "r_host string, r_path string, r string, v string")
    keys = df.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    best = (
        keys.select("host", "path", F.explode(suffixes).alias("r_host"))
        .join(table, "r_host")
        .where(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("r").alias("n"), "r", "v")).alias("m"))
        .select("host", "path", F.col("m.r").alias("rule"), F.col("m.v").alias("rule_verdict"))
    )
    return df.join(best, ["host", "path"], "left")


def lower_bound(share: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of Wilson's interval for a share of n."""
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - half) / (1 + z * z / n)


def mine_rules(
    labelled: DataFrame, min_support: float = 0.0005, min_confidence: float = 0.5, max_tokens: int = 4, min_bad: int = 10
) -> DataFrame:
    """(tokens, rarest, confidence, support) of the combinations that imply a bad label.

    labelled: ``tokens array<string>, bad boolean``. A rule's support is the share of labelled
    urls that hold its tokens and are bad; it is ``min_bad`` urls at least. Its confidence is the lower end of the interval of the share
    of bad ones. A rule is dropped when a part of it is a rule as well.
    """
    bad = "label:bad"
    basket = labelled.select(
        F.when(F.col("bad"), F.array_append("tokens", F.lit(bad))).otherwise(F.col("tokens")).alias("items")
    ).where(F.size("items") > 0)
    total = max(1, basket.count())
    # Half a url below the floor, so that rounding drops no rule that stands on it.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, (min_bad - 0.5) / total)), minConfidence=min_confidence).fit(basket)
    found = durable(
        model.associationRules.where(F.col("consequent") == F.array(F.lit(bad)))
        .where(F.size("antecedent") <= max_tokens)
        .select(F.array_sort("antecedent").alias("tokens"), lower_bound(F.col("confidence"), F.col("support") * total / F.col("confidence")).alias("confidence"), "support")
        .where(F.col("confidence") >= min_confidence)
    )
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("t"), "freq")
    rarest = (
        found.select("tokens", "confidence", "support", F.explode("tokens").alias("t"))
        .join(single, "t")
        .groupBy("tokens", "confidence", "support")
        .agg(F.min(F.struct("freq", "t")).alias("m"))
        .select("tokens", "confidence", "support", F.col("m.t").alias("rarest"))
    )
    # A longer rule meets every shorter one that it contains under that one's rarest token.
    short = rarest.select(F.col("tokens").alias("part"), F.col("rarest").alias("t"))
    implied = (
        rarest.select("tokens", F.explode("tokens").alias("t"))
        .join(short, "t")
        .where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
        .select("tokens")
        .distinct()
    )
    return durable(rarest.join(implied, "tokens", "left_anti"))


def mined_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Distinct (host, path) of ``pages`` that a mined rule fits, with the surest rule's confidence."""
    keys = pages.select("host", "path").distinct().withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    index = rules.select(F.col("rarest").alias("t"), F.col("tokens").alias("need"), "confidence")
    if rules.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    return (
        keys.select("host", "path", "tokens", F.explode("tokens").alias("t"))
        .join(index, "t")
        .where(F.size(F.array_except("need", "tokens")) == 0)
        .groupBy("host", "path")
        .agg(F.max(F.struct("confidence", "need")).alias("m"))
        .select("host", "path", F.col("m.confidence").alias("confidence"), F.array_join("m.need", " ").alias("mined_rule"))
    )


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    min_support: float = 0.0005,
    min_confidence: float = 0.5,
    default: str = "allow",
    min_bad: int = 10,
) -> DataFrame:
    """Verdicts of ``pages(page_id, url)`` given ``labels(page_id, bad boolean)`` and explicit rules.

    Returns page_id, host, path, rule, verdict, mined_rule, confidence.
    """
    split = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    marks = labels.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = split.join(marks, "page_id").select(url_tokens(F.col("host"), F.col("path")).alias("tokens"), "bad")
    mined = mine_rules(labelled, min_support, min_confidence, min_bad=min_bad)
    judged = explicit_rule(split, rules)
    if mined.isEmpty():
        found = judged.withColumns({"mined_rule": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    else:
        hit = mined_verdicts(judged.where(F.col("rule").isNull()), mined)
        found = judged.join(hit, ["host", "path"], "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise(F.lit(default)))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined_rule", "confidence")

"""How sources of a language differ: distances between all pairs of its sources, and the terms that mark each source.

Terms are runs of letters (A to Z, lower-cased, and all that is not ASCII). A language keeps the terms that at least ``least_docs`` of
its documents hold; V is their number. A group is a (lang, source). With c occurrences of a term in a group and N of all kept terms
there, the term's share is p = 1 + floor(10^9 (c + 5) / (N + 5 V)), in whole numbers; shares q of the language are alike.

Pairs come from postings. A term that neither group holds has the groups' shares of a zero count, so
``distance(a, b) = own(a, b) + own(b, a) + (V - n_a - n_b) |zero_a - zero_b| + both(a, b)``, where own(a, b) sums |p_a - zero_b| over
a's terms, from the counts' histogram, and both(a, b) corrects the terms that both hold, from the posting lists: each list gives its
pairs of groups, which are summed before they are shuffled.

Marking terms, the ``top`` ones with the greatest p - q > 0, come from an upper-bound search. A group's terms stand in buckets of
like counts; with the greatest count and the least share q of the language in it, a bucket bounds p - q of all its terms. Rounds evaluate
buckets of all groups at once, the best bounds first, four times as many terms in each round; a group is done when the bounds of all that
it has not seen are strictly below its ``top``-th value (ties of that value are thus seen), or not above zero. What meets at the driver is
the number of groups that are not done.

Scale: tasks count terms of each group in bounded dictionaries and flush them; counts are summed before they are shuffled, so a hot
group or word is a row a flush. There are at most 8 buckets an octave of counts, so the bounds are a small table.

Defined cases: null text, lang and source are ''. A group without kept terms has pairs, from shares of zero counts, and no terms; V = 0
gives distance 0. Repeated rows count repeatedly. Equal values are ranked by the item's UTF-8 bytes. Very long texts are read whole, in
slices between terms. Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, discard, written

LEAST_DOCS = 30
TOP = 50
ROUND_GROWTH = 4
#: Terms of all groups in a task's dictionaries before they are flushed.
HELD_TERMS = 1 << 18

_BIG = "decimal(38,0)"


def _term_table() -> bytes:
    table = np.full(256, 32, np.uint8)
    table[65:91] = table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table.tobytes()


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text), no nulls, to (lang, source, term, c, docs): occurrences and documents that hold the term. A group has a row with a null term besides."""
    table = _term_table()
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("docs", pa.int64())])

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, in_docs) in held.items():
            terms = [None, *(t.decode() for t in count)]
            n = len(terms)
            columns = [[lang] * n, [source] * n, terms, [0, *count.values()], [0, *(in_docs[t] for t in count)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                every, in_docs = held[lang, source]
                size -= len(every)
                terms = text.as_py().translate(table).split()
                every.update(terms)
                in_docs.update(set(terms))
                size += len(every)
                if size > HELD_TERMS:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    found = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, c bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def _share(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (c + 5) / (n + 5 v)), exactly; null if there are no terms."""
    whole = lambda x: x.cast(_BIG)
    top = (F.lit(10**9).cast("decimal(10,0)") * (c + 5).cast("decimal(20,0)")).cast(_BIG)
    return F.lit(1) + F.call_function("div", top, F.nullif(whole(n + 5 * v), F.lit(0).cast(_BIG)))


def _facts(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(terms, groups): (lang, source, term, c, p, q) of kept terms that a group holds; (lang, source, v, zero) with V and the share of a zero count."""
    kept = written(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("c").alias("all_c"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_c").alias("all_n"))
    held = written(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]))
    of = held.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("n_terms"))
    groups = counts.where("term is null").select("lang", "source").join(of, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["n", "n_terms", "v", "all_n"]).withColumn("zero", _share(F.lit(0), F.col("n"), F.col("v")))
    groups = written(groups)
    # Few groups are broadcast by their size; many are shuffled, by keys that are then spread.
    terms = held.join(groups.select("lang", "source", "n", "v", "all_n"), ["lang", "source"])
    terms = terms.select("lang", "source", "term", "c", _share(F.col("c"), F.col("n"), F.col("v")).alias("p"), _share(F.col("all_c"), F.col("all_n"), F.col("v")).alias("q"))
    terms = written(terms)
    discard(kept, held)
    return terms, groups


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    end = lambda name: groups.select("lang", "v", F.col("source").alias(name), F.col("zero").alias(f"zero_{name}"), F.col("n_terms").alias(f"n_{name}"))
    pairs = end("a").join(end("b").drop("v"), "lang").where("a <> b")

    histogram = terms.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("times"))
    own = histogram.join(end("b"), "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("p") - F.col("zero_b")) * F.col("times")).alias("own"))

    listed = terms.join(groups.select("lang", "source", "zero"), ["lang", "source"]).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("posting"))
    # A posting has a group at most once, so its length is bounded by the language's sources.
    ends = listed.select("lang", "posting", F.explode("posting").alias("a")).select("lang", "a", F.explode("posting").alias("b")).where("a.source < b.source")
    gap = F.expr("abs(a.p - b.p) - abs(a.p - b.zero) - abs(b.p - a.zero) + abs(a.zero - b.zero)")
    both = ends.groupBy("lang", F.col("a.source").alias("a"), F.col("b.source").alias("b")).agg(F.sum(gap).alias("both"))
    both = both.select("lang", "a", "b", "both").unionAll(both.select("lang", F.col("b"), F.col("a"), "both"))

    back = own.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("own").alias("back"))
    joined = pairs.join(own, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    neither = (F.col("v") - F.col("n_a") - F.col("n_b")) * F.abs(F.col("zero_a") - F.col("zero_b"))
    nil = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.coalesce(nil("own") + nil("back") + neither + nil("both"), F.lit(0)).cast("bigint").alias("value"))


def marking_terms(terms: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the ``top`` terms of each group with the greatest p - q above zero."""
    key = ["lang", "source"]
    terms = terms.withColumn("bucket", F.floor(8 * F.log2("c")).cast("int"))
    bounds = terms.groupBy(*key, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("n"))
    best = W.partitionBy(*key).orderBy(F.desc("bound"), "bucket")
    before = F.coalesce(F.sum("n").over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Round r starts with top * (growth^r - 1) terms seen.
    turn = F.floor(F.log(float(ROUND_GROWTH), before / top + 1) + 1e-9).cast("int")
    buckets = written(bounds.where("bound > 0").withColumn("turn", turn))
    last = buckets.agg(F.max("turn")).first()[0]
    found, open_, spent = None, buckets.select(*key).distinct(), [buckets]
    for now in range((last if last is not None else -1) + 1):
        asked = buckets.where(F.col("turn") == now).join(open_, key, "left_semi").select(*key, "bucket")
        new = terms.join(asked, [*key, "bucket"], "left_semi").where("p > q").select(*key, F.col("term").alias("item"), (F.col("p") - F.col("q")).cast("bigint").alias("value"))
        every = new if found is None else found.drop("rank").unionAll(new)
        ranked = every.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("value"), "item")))
        found = written(ranked.where(F.col("rank") <= top))
        spent.append(found)
        unseen = buckets.where(F.col("turn") > now).groupBy(*key).agg(F.max("bound").alias("bound"))
        kth = found.where(F.col("rank") == top).select(*key, F.col("value").alias("kth"))
        open_ = written(unseen.join(open_, key, "left_semi").join(kth, key, "left").where("kth is null or bound >= kth").select(*key))
        spent.append(open_)
        if not open_.count():
            break
    if found is None:
        found = terms.where("false").select(*key, F.col("term").alias("item"), F.lit(0).cast("bigint").alias("value"), F.lit(0).alias("rank"))
    discard(*[t for t in spent if t is not found])
    return found.select(*key, "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """docs(text, lang, source) to (lang, source, part, item, value, rank): part ``pair`` has all other sources of the language, ``term`` the ``top`` marking terms."""
    bound_batches(docs.sparkSession)
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = written(term_counts(clean))
    terms, groups = _facts(counts, least_docs)
    discard(counts)
    pairs = source_pairs(terms, groups).withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    parts = [(name, df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))) for name, df in (("pair", pairs), ("term", marking_terms(terms, top)))]
    return parts[0][1].unionAll(parts[1][1])

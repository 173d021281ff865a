"""Near copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

A prefix join. The distinct shingles of a text are put in one order for all texts; of two texts with n and m shingles that are
similar enough, some shingle stands among the first n - ceil(4n/5) + 1 of one and the first m - ceil(4m/5) + 1 of the other. Texts meet on
these shingles, and the places and sizes of the first one that they share bound what else they can share. What is
left is verified on the whole sets. The order puts shingles that are common in a sample of the texts last, so that they are
seldom met on; any order gives the same pairs.

Texts with the same set are one node from the start. In a bucket of many nodes a few of them are first held against all others; pairs
of nodes that are not in one component then are all taken. So a large group of near copies gives links in
proportion to its members, and a common shingle of unlike texts gives all its pairs.

Defined cases: as in :mod:`simhash`. Texts without a word have one set and are copies of each other; fewer words than a shingle count
as the whole sequence. Words are ASCII-lowered, and shingles are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, input_tasks, release, text_slices, written
from .components import components
from .hpylm import word_hashes

WIDTH = 5
#: Similarity as a fraction.
LEAST, OF = 4, 5
SAMPLE = 5000
#: Up to so many nodes in pairs are broadcast to fetch their sets; more of them are joined by a shuffle.
BROADCAST_NODES = 1_000_000
_CHUNK = 1 << 16
_SMALL = 48
_CENTRES = 8
#: Pairs of one centre that go to one task.
_PART = 1024
_U = np.uint64
_STEP = np.random.default_rng(20240811).integers(0, 2**63, WIDTH, dtype=np.int64).view(_U) * _U(2) + _U(1)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts, at = [t or b"" for t in texts], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
            size += len(texts[end])
            end += 1
        h, count = word_hashes(texts[at:end])
        upto = np.cumsum(count)
        for a, b in zip((upto - count).tolist(), (upto - 1).tolist()):  # without the end token
            k = min(WIDTH, b - a)
            n = b - a - k + 1 if k else 1
            s = np.full(n, k, _U)
            for j in range(k):
                s += h[a + j : a + j + n] * _STEP[j]
            s = (s ^ (s >> _U(31))) * _U(0x7FB5D329728EA185)
            yield np.unique(s ^ (s >> _U(29)))
        at = end


def node_id(found: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(found.tobytes()), np.int64)[0])


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for _, part in text_slices(column):
        yield from shingle_sets(part.cast(pa.large_binary()).to_pylist())


def _nodes(text: pa.Array) -> pa.Array:
    return pa.array([node_id(s) for s in _texts(text)], pa.int64())


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in _texts(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["s"])


def common_shingles(texts: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle, count) of those that occur more than once in a hashed sample of the texts."""
    step = max(1, texts.count() // sample)
    rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).mapInArrow(_shingles, "s bigint").groupBy("s").count()
    got = rows.where("count > 1").orderBy(F.col("count").desc(), "s").limit(500_000).toArrow()
    s, n = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(s.view(_U))
    return s.view(_U)[order], n[order]


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles, by their count in the sample and their hash, of which similar texts share one."""
    known, count = common
    n = len(found)
    keep = n - -(-LEAST * n // OF) + 1
    if not len(known):
        return found[:keep]
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    often = np.where(known[at] == found, count[at], 0)
    return found[np.argsort(often, kind="stable")[:keep]]


def _entries(common):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, node, place: 2**32 * number of shingles + position of the key."""
        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                keys, nodes, places = [], [], []
                for s in shingle_sets(part.cast(pa.large_binary()).to_pylist()):
                    first = prefix(s, common.value)
                    keys.append(first)
                    nodes.append(np.full(len(first), node_id(s)))
                    places.append((len(s) << 32) + np.arange(len(first)))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(places))], names=["key", "node", "place"]
                    )

    return of


def may_be_near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets can be similar if the shingle at these places is the first that they share."""
    n, m = p >> 32, q >> 32
    most = np.minimum(n - (p & 0xFFFFFFFF), m - (q & 0xFFFFFFFF))
    return (LEAST + OF) * most >= LEAST * (n + m)


def _meet(batches: Iterator[pa.RecordBatch], bucket) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, as arrays of whole buckets to ``bucket``; the last bucket of a batch waits for the next."""
    held = None
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]):
            other = np.flatnonzero(held[0] != held[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from bucket(*[h[:cut] for h in held])
            held = [h[cut:] for h in held]
    if held is not None and len(held[0]):
        yield from bucket(*held)


def _pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if not parts:
        return np.zeros((0, 2), np.int64)
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)


def _rows(pairs: np.ndarray, *members: np.ndarray) -> pa.RecordBatch:
    key, node, place = members if members else [np.zeros(0, np.int64)] * 3
    cols = [np.concatenate(c) for c in ((pairs[:, 0], key), (pairs[:, 1], node), (np.full(len(pairs), -1), place))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "place"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, -1), and the members (key, node, place) of buckets of which only some pairs are taken."""

    def bucket(key, node, place):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        out, many = [], []
        for s, n in zip(start[size > _SMALL].tolist(), size[size > _SMALL].tolist()):
            # Repeats of a set come from different rows.
            _, once = np.unique(node[s : s + n], return_index=True)
            once += s
            for c in once[np.linspace(0, len(once) - 1, _CENTRES).astype(np.int64)].tolist():
                near = once[may_be_near(place[once], np.full(len(once), place[c]))]
                out.append((np.full(len(near), node[c]), node[near]))
            many.append(once)
        at = np.flatnonzero(np.repeat((size > 1) & (size <= _SMALL), size))
        run = np.repeat(np.arange(len(size)), size)[at]
        for step in range(1, min(_SMALL, len(at))):
            same = np.flatnonzero(run[step:] == run[:-step])
            if not len(same):
                break
            i, j = at[same], at[same + step]
            near = may_be_near(place[i], place[j])
            out.append((node[i][near], node[j][near]))
        many = np.concatenate(many) if many else np.zeros(0, np.int64)
        yield _rows(_pairs(out), key[many], node[many], place[many])

    yield from _meet(batches, bucket)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (key, node, place, label) to all pairs in a bucket whose labels differ."""

    def bucket(key, node, place, label):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
            if (label[s:e] == label[s]).all():
                continue
            for i in range(s, e - 1):
                j = i + 1 + np.flatnonzero((label[i + 1 : e] != label[i]) & may_be_near(place[i + 1 : e], np.full(e - i - 1, place[i])))
                if len(j):
                    yield _rows(_pairs([(np.full(len(j), node[i]), node[j])]))

    yield from _meet(batches, bucket)


def similar(x: bytes, y: bytes) -> bool:
    both = np.concatenate([np.frombuffer(x, _U), np.frombuffer(y, _U)])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return (LEAST + OF) * shared >= LEAST * len(both)


def histogram(found: np.ndarray) -> bytes:
    """Size of a set, and how many of its shingles have the same leading bits, about one of them a slot."""
    bits = max(4, int(len(found)).bit_length())
    count = np.bincount((found >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    # Slots that a byte cannot hold (not seen with 64-bit hashes) leave the set without a histogram, which excludes nothing.
    return len(found).to_bytes(8, "little") + (count.astype(np.uint8).tobytes() if count.max() < 256 else b"")


def may_be_similar(x: bytes, y: bytes) -> bool:
    """Sets share no more than the lesser counts of all slots; the finer histogram is added up to the coarser one's slots."""
    n, m = (int.from_bytes(v[:8], "little") for v in (x, y))
    a, b = (np.frombuffer(v, np.uint8, -1, 8).astype(np.int64) if len(v) > 8 else None for v in (x, y))
    if a is None or b is None:
        return True
    size = min(len(a), len(b))
    most = int(np.minimum(a.reshape(size, -1).sum(axis=1), b.reshape(size, -1).sum(axis=1)).sum())
    return (LEAST + OF) * most >= LEAST * (n + m)


def _sets(what):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                found = list(shingle_sets(part.cast(pa.large_binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([node_id(s) for s in found], pa.int64()), pa.array([what(s) for s in found], pa.binary())], names=["node", "found"])

    return of


def _hold(check):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (centre, part, node, found) sorted so that a centre's own row (null node) comes first in a part: the nodes that pass the check with it."""
        now, own = None, None
        for batch in batches:
            near = []
            found = batch.column("found")
            for i, (c, part, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("centre", "part", "node")))):
                if n is None:
                    now, own = (c, part), found[i].as_py()
                near.append(n is not None and now == (c, part) and check(own, found[i].as_py()))
            yield batch.select(["centre", "node"]).filter(pa.array(near, pa.bool_()))

    return of


def fetched(texts: DataFrame, pairs: DataFrame, what) -> DataFrame:
    """(node, found) with ``what`` of the set of every node in pairs (a, b), as a table."""
    ends = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    if ends.count() <= BROADCAST_NODES:
        ends = F.broadcast(ends)
    out = written(texts.mapInArrow(_sets(what), "node bigint, found binary").join(ends, "node", "left_semi").dropDuplicates(["node"]))
    release(texts.sparkSession)
    return out


def passing(sets: DataFrame, pairs: DataFrame, check) -> DataFrame:
    """Of the candidate pairs (a, b) those whose values in sets(node, found) pass the check, as a table.

    A pair's second value goes to its first one, which is sent once a part of ``_PART`` pairs, so a centre of many pairs is split.
    """
    counts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / _PART).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    asked = pairs.join(counts, "a").select(F.col("a").alias("centre"), part, F.col("b").alias("node")).join(sets, "node").select("centre", "part", "node", "found")
    centres = counts.join(sets, F.col("a") == F.col("node")).select(F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"), "found")
    dealt = centres.unionAll(asked).repartition(input_tasks(sets.sparkSession), "centre", "part").sortWithinPartitions("centre", "part", F.col("node").asc_nulls_first())
    out = written(dealt.mapInArrow(_hold(check), "centre bigint, node bigint").select(F.col("centre").alias("a"), F.col("node").alias("b")))
    discard(counts)
    release(sets.sparkSession)
    return out


def spanning_links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (fa, fb) with the closure of all similar ones among the candidate pairs (a, b).

    Histograms, an eighth of the sets in size, exclude most pairs exactly. Then every node is held against its least partner; pairs that are
    connected by that need no look, and all others are verified on the whole sets.
    """
    slots = fetched(texts, pairs, histogram)
    pairs = passing(slots, pairs, may_be_similar)
    discard(slots)
    sets = fetched(texts, pairs, np.ndarray.tobytes)
    first = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = passing(sets, first, similar)
    name = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    at = lambda end: name.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
    rest = written(rest.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b"))
    out = links if rest.isEmpty() else links.unionAll(passing(sets, rest, similar))
    out = written(out.select(F.col("a").alias("fa"), F.col("b").alias("fb")))
    discard(sets)
    return out


def jaccard_links(texts: DataFrame) -> DataFrame:
    """texts(text) to links (fa, fb) of sets whose closure is that of all similar pairs."""
    spark = texts.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(texts))
    entries = texts.mapInArrow(_entries(common), "key bigint, node bigint, place bigint")
    dealt = entries.repartition(input_tasks(spark), "key").sortWithinPartitions("key")
    met = written(dealt.mapInArrow(_candidates, "a bigint, b bigint, place bigint"))
    del entries, dealt
    release(spark)  # the entries' shuffle is not needed any more
    links = spanning_links(texts, written(met.where("place < 0").select("a", "b").distinct()))
    many = met.where("place >= 0").select(F.col("a").alias("key"), F.col("b").alias("node"), "place")
    if many.isEmpty():
        return links
    label = components(links.select(F.col("fa").alias("u"), F.col("fb").alias("v")))
    named = many.join(label, "node", "left").select("key", "node", "place", F.coalesce("component", "node").alias("label"))
    dealt = named.repartition(input_tasks(spark), "key").sortWithinPartitions("key")
    rest = written(dealt.mapInArrow(_apart, "a bigint, b bigint, place bigint").select("a", "b").distinct())
    return links if rest.isEmpty() else links.unionAll(spanning_links(texts, rest))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (of the set of shingles), component_id of every row of ``docs(doc_id, text)``."""
    marked = written(docs.select("doc_id", F.arrow_udf(_nodes, "bigint")("text").alias("fp")))
    return simhash.grouped(marked, jaccard_links(docs.where("doc_id is not null").select("text")))


def keep_first(docs: DataFrame) -> DataFrame:
    """As :func:`simhash.keep_first`, of groups that SimHash links and links of near copies make together.

    SimHash groups the rows first. Near copies whose fingerprints differ in more bits than its radius are then linked by their sets, and groups
    that such links connect are one: its id is the least of all their rows.
    """
    rows = docs.select("doc_id", "text")
    hashed = written(simhash.near_duplicates(rows).withColumnRenamed("component_id", "first"))
    sets = rows.select("doc_id", F.arrow_udf(_nodes, "bigint")("text").alias("node")).where("doc_id is not null")
    # A group's id stands on as many rows as it has different sets, which are linked through it.
    groups = sets.join(hashed.where("first is not null").select("doc_id", "first").distinct(), "doc_id")
    marked = written(groups.select(F.col("first").alias("doc_id"), F.col("node").alias("fp")).distinct())
    found = simhash.grouped(marked, jaccard_links(rows.where("doc_id is not null").select("text")))
    heads = found.where("doc_id = component_id").select("doc_id").distinct()
    return simhash.keep_heads(docs, hashed.where("doc_id = first").select("doc_id", F.col("first").alias("component_id")).join(heads, "doc_id", "left_semi"))

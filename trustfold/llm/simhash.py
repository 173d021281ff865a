"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. For a
radius of three bits the fingerprint is cut in two halves: of two fingerprints within the radius, some
half differs in one bit at most. Every distinct fingerprint therefore emits, for each half, all
variants of that half within one bit (half the radius, rounded down); fingerprints meet on a variant that is exact for at
least one of them, and the full distance is verified there. Inside a variant's bucket only a spanning
forest of verified links is emitted, so a large group gives links in proportion to its members.

Exact copies share a fingerprint and are one node from the start. Memory is bounded by an Arrow
batch, except for a bucket of distinct fingerprints that agree on half their bits, which is compared
in blocks.

Defined cases: a null text and one without words have fingerprint zero and link like any other;
fewer words than a shingle hash as the whole sequence; very long texts are read whole; repeated rows are all returned; a null id gets a
fingerprint, takes no part in links and has a null component. An empty table gives an empty result.
Other columns are ignored by :func:`near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_tasks, text_slices, written
from .components import components

SEED = 42
RADIUS = 3
_BLOCK = 8192


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(width, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), _BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    packed = np.packbits(2 * ones > len(first), bitorder="little")
    return int(packed.view(np.uint64)[0])


def _fingerprints(batch: pa.Array, width: int) -> pa.Array:
    texts = (t for _, part in text_slices(batch) for t in part.cast(pa.large_binary()).to_pylist())
    found = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(batch))
    return pa.array(found.view(np.int64))


def fingerprint_udf(width: int = 3):
    @F.arrow_udf("bigint")
    def of(text: pa.Array) -> pa.Array:
        return _fingerprints(text, width)

    return of


def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp to (key, fp): for each half, the half itself and its 32 one-bit variants."""
    flips = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(every), 2000):
            fp = every[at : at + 2000]
            halves = np.stack([fp & low, fp >> np.uint64(32)], axis=1)
            side = np.array([0, 1], np.uint64) << np.uint64(32)
            keys = (halves[:, :, None] ^ flips[None, None, :]) | side[None, :, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, 66).view(np.int64))], names=["key", "fp"]
            )


def _exact(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    half = np.where(key >> np.uint64(32), fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
    return half == (key & np.uint64(0xFFFFFFFF))


def _run_links(fp: np.ndarray, exact: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links between exact members and all members of one large bucket."""
    label, out = np.arange(len(fp)), []
    for i in np.flatnonzero(exact):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= radius)
        other, at = np.unique(label[near], return_index=True)
        new = other != label[i]
        if new.any():
            ends = fp[near[at[new]]]
            out.append((np.full(len(ends), fp[i]), ends))
            label[np.isin(label, other)] = label[i]
    return out


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole buckets; rows sorted by key."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    exact = _exact(key, fp)
    useful = (size > 1) & (np.add.reduceat(exact, start) > 0)
    left, right = [], []
    for s, n in zip(start[useful & (size > 48)].tolist(), size[useful & (size > 48)].tolist()):
        for a, b in _run_links(fp[s : s + n], exact[s : s + n], radius):
            left.append(a)
            right.append(b)
    small = np.repeat(useful & (size <= 48), size)
    run, f, x = np.repeat(np.arange(len(size)), size)[small], fp[small], exact[small]
    for step in range(1, min(48, len(f))):
        same = run[step:] == run[:-step]
        if not same.any():
            break
        ok = same & (x[step:] | x[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= radius)
        left.append(f[:-step][ok])
        right.append(f[step:][ok])
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _links(radius: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, fp) sorted by key; the last bucket of a batch waits for the next batch."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(k):
                a, b = bucket_links(k, f, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["fa", "fb"])

        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if not len(key):
                continue
            held.append((key, fp))
            if key[-1] == held[0][0][-1]:
                continue  # all of it is the open bucket
            key, fp = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield from emit(key[:cut], fp[:cut])
            held = [(key[cut:], fp[cut:])]
        if held:
            yield from emit(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))

    return of


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps(fp bigint, distinct) to links (fa, fb) whose closure is that of all pairs within the radius."""
    if radius > 3:
        raise ValueError("balls of one bit in each half reach a radius of three")
    variants = fps.select("fp").mapInArrow(ball, "key bigint, fp bigint")
    dealt = variants.repartition(input_tasks(fps.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(radius), "fa bigint, fb bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed 64-bit fingerprint), component_id of every row of ``docs(doc_id, text)``."""
    marked = written(docs.select("doc_id", fingerprint_udf(width)("text").alias("fp")))
    return grouped(marked, fingerprint_links(marked.where("doc_id is not null").select("fp").distinct(), radius))


def grouped(marked: DataFrame, links: DataFrame) -> DataFrame:
    """marked(doc_id, fp) and links(fa, fb) to marked with component_id, the least id that is linked to a row."""
    nodes = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    a, b = nodes.select(F.col("fp").alias("fa"), F.col("rep").alias("u")), nodes.select(F.col("fp").alias("fb"), F.col("rep").alias("v"))
    # One id may stand on several rows with different texts; its fingerprints are then linked through it.
    same = marked.where("doc_id is not null").join(nodes, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    repeated = same.join(nodes.select(F.col("rep").alias("u")), "u", "left_semi")
    found = components(links.join(a, "fa").join(b, "fb").select("u", "v").unionAll(repeated.select("u", "v")))
    classes = nodes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` that stay when of each group only the row with the least id is kept.

    Rows without an id stay. Of several rows of that id the one with the least text stays.
    """
    return keep_heads(docs, near_duplicates(docs.select("doc_id", "text"), width, radius))


def keep_heads(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is that of their group in found(doc_id, component_id); see :func:`keep_first`."""
    heads = written(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("head")).agg(F.count("*").alias("n")))
    rows = docs.select(F.struct("*").alias("doc"))
    chosen = lambda which: rows.join(heads.where(which), F.col("doc.doc_id") == F.col("head"), "left_semi")
    least = chosen("n > 1").groupBy("doc.doc_id").agg(F.min_by("doc", F.coalesce("doc.text", F.lit(""))).alias("doc"))
    kept = chosen("n = 1").unionByName(least.select("doc")).unionByName(rows.where("doc.doc_id is null"))
    return kept.select("doc.*")

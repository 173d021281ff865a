"""Repeated-passage removal with suffix order and longest-previous-factor arrays, on bytes.

A passage is a string of ``length`` bytes; all places where one starts that also starts elsewhere are found
exactly, in any document, the same one included. To spread the suffixes over tasks, each passage is sent where its anchor is
sent: of the 100-byte strings in it, the one with the least hash, leftmost. Equal passages have equal anchors at equal
places, so they meet. Neighbouring passages with one anchor travel together as a segment.

1. Segments are counted by (anchor, content digest) with map-side sums. Equal segments are one class from here on: that all of a class with a
   count above one is repeated is decided by digests (128 bits), not by the arrays below.
2. Anchors that have several different segments are dealt to tasks, and the suffixes that start passages are put in
   suffix order by prefix doubling. From the previous and next smaller (larger) positions in that order come the longest
   previous (next) factors, and with them the passages that start earlier (later) as well.
3. Anchors with more different segments than ``most_segments`` would fill a task. Their segments are cut into single passages, which
   step 1 resolves alone: each is repeated if its digest is, and its first place is the first place of that digest.

Order of places: document id (null last), row key, position. Bytes of repeated passages are removed, all or all but the first
copies. No task holds more than a batch of texts or ``most_segments`` segments.

Defined cases: a null text is empty, and texts shorter than ``length`` have no passages; repeated rows (equal id and text) are copies of
one another, but share one place, so removal of later copies keeps both; periodic texts repeat within themselves. Very long
texts are read whole; one above 1 GiB is an error. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, input_tasks, written

LENGTH = 400
GRAM = 100
_PIECE = 1 << 17
_CHUNK = 1 << 19
_POSITION_BITS = 30
_U = np.uint64
_LETTER = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.int64).view(_U) * _U(2) + _U(1)
_R = _U(0x5851F42D4C957F2D)
_R_INV = _U(pow(int(_R), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    step = np.full(n, base, _U)
    step[:1] = 1
    return np.multiply.accumulate(step)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the bytes from every position; the last gram - 1 positions have none."""
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTER[data] * _powers(_R, len(data)), out=total[1:])
    h = (total[gram:] - total[:-gram]) * _powers(_R_INV, len(data))[: len(data) - gram + 1]
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    return h ^ (h >> _U(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, from minima over blocks forwards and backwards."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, _U)]).reshape(-1, width)
    after = np.minimum.accumulate(padded, axis=1).reshape(-1)
    before = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(before[:n], after[width - 1 : width - 1 + n])


def anchored(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of concatenated texts: (text number, first start, last start, anchor's place after the first start, anchor hash)."""
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, _U),)
    if len(data) < length:
        return none
    if len(data) >> _POSITION_BITS:
        raise ValueError("a text is longer than 1 GiB")
    hashes = gram_hashes(data, gram)
    at = np.arange(len(hashes), dtype=_U)
    low = _U((1 << _POSITION_BITS) - 1)
    least = sliding_least((hashes & ~low) | at, length - gram + 1) & low
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    start = np.arange(len(least))
    valid = start + length <= ends[text]
    if not valid.any():
        return none
    start, text, anchor = start[valid], text[valid], least[valid].astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return text[first], start[first], start[last], anchor[first] - start[first], hashes[anchor[first]]


def _pieces(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) in slices of limited size."""
    column = batch.column("text")
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right")))
        yield at, [t or b"" for t in column.slice(at, end - at).cast(pa.large_binary()).to_pylist()]
        at = end


def _digests(data: bytes, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """128 bits of each segment's bytes and its anchor's place, as two columns."""
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(data[a:b], p) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist())])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _segments(length: int, gram: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for at, texts in _pieces(batch, _PIECE):
                whole = b"".join(texts)
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                text, first, last, place, anchor = anchored(np.frombuffer(whole, np.uint8), sizes, length, gram)
                if not len(text):
                    continue
                digest = _digests(whole, first, last + length, place)
                base = (np.cumsum(sizes) - sizes)[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[at + text]), batch.column("doc_id").take(pa.array(at + text)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)),
                        pa.array(anchor.view(np.int64)), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])),
                    ],
                    names=["row", "doc_id", "first", "last", "anchor", "d1", "d2"],
                )

    return of


def prefix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank of the ``size`` bytes from each position) for doubled sizes up to ``length``; zero bytes follow the end."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), _U)
    for i in range(8):
        key = (key << _U(8)) | pad[i : i + len(data)]
    size, out = min(8, length), []
    if length < 8:
        key >>= _U(8 * (8 - length))
    while True:
        order = np.argsort(key)
        new = np.concatenate([[False], key[order[1:]] != key[order[:-1]]])
        rank = np.empty(len(data), np.uint32)
        rank[order] = np.cumsum(new)
        out.append((size, rank))
        if size >= length:
            return out
        step = min(size, length - size)
        ahead = np.zeros(len(data), np.uint32)
        ahead[: max(0, len(data) - step)] = rank[step:] + np.uint32(1)
        key = (rank.astype(_U) << _U(32)) | ahead
        size += step


def common_prefix(data: np.ndarray, ranks: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at i and j, capped at the largest rank's size."""
    n, done = len(ranks[0][1]), np.zeros(len(i), np.int64)
    cap = ranks[-1][0]
    same = ranks[-1][1][i] == ranks[-1][1][j]
    done[same] = cap
    for size, rank in reversed(ranks[:-1]):
        for _ in range(2):
            a, b = i + done, j + done
            ok = ~same & (done + size <= cap) & (a < n) & (b < n)
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            done[ok] += size
    open_ = np.flatnonzero(~same)
    for _ in range(ranks[0][0]):  # what is left is less than the smallest rank's size
        a, b = i[open_] + done[open_], j[open_] + done[open_]
        ok = (done[open_] < cap) & (a < n) & (b < n)
        ok[ok] = data[a[ok]] == data[b[ok]]
        open_ = open_[ok]
        done[open_] += 1
    return done


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1."""
    found = np.arange(len(values)) - 1
    active = np.arange(len(values))
    while len(active):
        to = found[active]
        up = (to >= 0) & (values[np.maximum(to, 0)] > values[active])
        active = active[up]
        found[active] = found[found[active]]
    return found


def longest_factors(data: np.ndarray, starts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of the suffixes at ``starts`` (ascending), among them and capped.

    Candidates are the previous and next smaller positions in suffix order for the first, and the
    previous and next larger ones for the second.
    """
    ranks = prefix_ranks(data, cap)
    order = np.argsort(ranks[-1][1][starts], kind="stable")
    place = starts[order]
    out = []
    for value in (place, -place):
        best = np.zeros(len(starts), np.int64)
        for side in (nearest_smaller(value), len(value) - 1 - nearest_smaller(value[::-1])[::-1]):
            has = np.flatnonzero((side >= 0) & (side < len(value)))
            best[has] = np.maximum(best[has], common_prefix(data, ranks, place[has], place[side[has]]))
        by_start = np.empty(len(starts), np.int64)
        by_start[order] = best
        out.append(by_start)
    return out[0], out[1]


def _runs(flags: np.ndarray, owner: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of the maximal runs of set flags in neighbouring starts of one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (owner[at[1:]] != owner[at[:-1]]) | (rel[at[1:]] != rel[at[:-1]] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return owner[at[first]], rel[at[first]], rel[at[last]]


RANGES = "anchor bigint, d1 bigint, d2 bigint, earlier boolean, first int, last int"


def _factor(length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments sorted by anchor and place; whole anchors are gathered to chunks of limited size."""
        names = ["anchor", "d1", "d2", "bytes"]
        held: list[list] = [[], [], [], []]

        def done(cut: int) -> Iterator[pa.RecordBatch]:
            anchor, d1, d2, parts = (h[:cut] for h in held)
            for h in held:
                del h[:cut]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            data = np.frombuffer(b"".join(parts), np.uint8)
            base = np.cumsum(sizes) - sizes
            count = sizes - length + 1
            owner = np.repeat(np.arange(len(parts)), count)
            rel = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            previous, following = longest_factors(data, base[owner] + rel, length)
            for earlier, flags in ((False, (previous >= length) | (following >= length)), (True, previous >= length)):
                who, first, last = _runs(flags, owner, rel)
                if len(who):
                    pick = lambda x: pa.array([x[i] for i in who.tolist()], pa.int64())  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [pick(anchor), pick(d1), pick(d2), pa.array([earlier] * len(who)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                        names=["anchor", "d1", "d2", "earlier", "first", "last"],
                    )

        size = cut = 0
        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in names]):
                if held[0] and row[0] != held[0][-1]:
                    cut = len(held[0])
                    if size >= _CHUNK:
                        yield from done(cut)
                        size = cut = 0
                for h, v in zip(held, row):
                    h.append(v)
                size += len(row[3])
        if held[0]:
            yield from done(len(held[0]))

    return of


def _fetch(wanted: str, length: int):
    """Rows (text, places) to the bytes of the segments at these places, or to the digests of their single passages."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _pieces(batch, _PIECE):
                out: list[list] = [[] for _ in range(7)]
                for n, t in enumerate(texts):
                    for p in batch.column("places")[at + n].as_py():
                        if wanted == "bytes":
                            for o, v in zip(out, (p["anchor"], p["d1"], p["d2"], p["seq"], t[p["first"] : p["last"] + length])):
                                o.append(v)
                        else:
                            for rel in range(p["last"] - p["first"] + 1):
                                a = p["first"] + rel
                                w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(t[a : a + length]), np.int64).tolist()
                                for o, v in zip(out, (p["anchor"], p["d1"], p["d2"], p["seq"], rel, w1, w2)):
                                    o.append(v)
                kinds = [pa.int64()] * 4 + ([pa.binary()] if wanted == "bytes" else [pa.int32(), pa.int64(), pa.int64()])
                names = ["anchor", "d1", "d2", "seq", *(["bytes"] if wanted == "bytes" else ["rel", "w1", "w2"])]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=names)

    return of


def repeated_starts(docs: DataFrame, length: int = LENGTH, keep_earliest: bool = False, most_segments: int = 4096) -> DataFrame:
    """docs(row, doc_id, text) to (row, starts array<struct<first, last>>): ranges of positions where repeated passages start.

    keep_earliest: only passages that start at an earlier place as well.
    """
    gram = min(GRAM, max(1, length // 4))
    kind = dict(docs.dtypes)["doc_id"]
    tasks = input_tasks(docs.sparkSession)
    texts = docs.where(F.octet_length("text") >= length).select("row", "doc_id", "text")
    seen = written(texts.mapInArrow(_segments(length, gram), f"row bigint, doc_id {kind}, first int, last int, anchor bigint, d1 bigint, d2 bigint"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "first", "last")
    each = seen.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    by_anchor = each.groupBy("anchor").agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds"))
    each = written(each.join(written(by_anchor.where("all_n > 1")), "anchor"))

    several = written(
        each.where("kinds > 1").withColumn("hot", F.col("kinds") > most_segments).withColumn("seq", F.xxhash64("d1", "d2"))
        .select("anchor", "d1", "d2", "hot", "at", F.col("at.row").alias("row"), F.col("at.first").alias("first"), F.col("at.last").alias("last"))
    )
    key = ["anchor", "d1", "d2"]

    def fetched(wanted: str, hot: bool) -> DataFrame:
        spots = several.where(F.col("hot") == hot).groupBy("row").agg(F.collect_list(F.struct(*key, F.lit(0).cast("long").alias("seq"), "first", "last")).alias("places"))
        one = texts.select("row", "text").join(spots, "row").dropDuplicates(["row"])
        schema = "anchor bigint, d1 bigint, d2 bigint, seq bigint, " + ("bytes binary" if wanted == "bytes" else "rel int, w1 bigint, w2 bigint")
        return one.select("text", "places").mapInArrow(_fetch(wanted, length), schema).drop("seq")

    # Suffix order within an anchor follows the places of the segments' first copies.
    ordered = fetched("bytes", False).join(several.select(*key, "at"), key).repartition(tasks, "anchor").sortWithinPartitions("anchor", "at")
    ranges = ordered.select(*key, "bytes").mapInArrow(_factor(length), RANGES)
    if not several.where("hot").isEmpty():
        single = written(fetched("digests", True).join(several.select(*key, "at"), key))
        where = F.struct("at", "rel")
        counts = written(single.groupBy("anchor", "w1", "w2").agg(F.count("*").alias("n"), F.min(where).alias("least")).where("n > 1"))
        hits = single.join(counts, ["anchor", "w1", "w2"])
        alone = hits.select(*key, F.lit(False).alias("earlier"), F.col("rel").alias("first"), F.col("rel").alias("last"))
        after = hits.where(where > F.col("least")).select(*key, F.lit(True).alias("earlier"), F.col("rel").alias("first"), F.col("rel").alias("last"))
        ranges = ranges.unionByName(alone).unionByName(after)
    ranges = ranges.where(F.col("earlier") == keep_earliest).select(*key, F.col("first").alias("r_first"), F.col("last").alias("r_last"))

    # A verdict per kind of segment: all of it is repeated, or these ranges are.
    listed = ranges.groupBy(*key).agg(F.collect_list(F.struct("r_first", "r_last")).alias("ranges"))
    verdict = written(each.join(listed, key, "left").where("n > 1 or ranges is not null").select(*key, "n", "at", "ranges"))
    found = seen.join(verdict, key)
    whole = F.col("n") > 1
    if keep_earliest:
        whole = ~place.eqNullSafe(F.col("at"))
    shifted = F.transform("ranges", lambda r: F.struct((F.col("first") + r["r_first"]).alias("first"), (F.col("first") + r["r_last"]).alias("last")))
    starts = F.when(whole, F.array(F.struct("first", "last"))).otherwise(shifted)
    return found.select("row", F.explode(starts).alias("s")).groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("starts"))


def removed_spans(starts: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by passages that start in the given ranges (sorted)."""
    out: list[list[int]] = []
    for s in starts:
        a, b = s["first"], s["last"] + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(length: int):
    def of(text: pa.Array, starts: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip(text.cast(pa.large_binary()).to_pylist(), starts.to_pylist()):
            t = t or b""
            spans = removed_spans(s or [], length)
            kept, at = [], 0
            for a, b in spans:
                kept.append(t[at:a])
                at = b
            kept = b"".join([*kept, t[at:]])
            rows.append({"n_bytes": len(t), "n_removed": len(t) - len(kept), "spans": [{"first": a, "last": b} for a, b in spans], "kept": kept})
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.binary())]))

    return of


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_earliest: bool = False, **how) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, n_removed, spans (byte ranges, end exclusive) and kept (the remaining bytes)."""
    bound_batches(docs.sparkSession)
    key = F.xxhash64("doc_id", "text")
    marked = docs.select("doc_id", "text", key.alias("row"))
    starts = repeated_starts(marked, length, keep_earliest, **how)
    kind = "struct<n_bytes:bigint,n_removed:bigint,spans:array<struct<first:bigint,last:bigint>>,kept:binary>"
    cut = F.arrow_udf(_cut(length), kind)
    return marked.join(starts, "row", "left").select("doc_id", cut(F.col("text"), F.col("starts")).alias("c")).select("doc_id", "c.*")

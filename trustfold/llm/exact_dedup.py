"""Exact duplicates by counting quotient filters.

A text (null is empty) is normalised by lower-casing A-Z and has a fingerprint of up to 64 bits. Each input partition builds
counting quotient filters of its fingerprints, one for each range of fingerprints, so that filters of a range meet in one task
wherever their rows came from. A filter splits a fingerprint into quotient and remainder, keeps the remainders of a quotient as a
sorted run (bit vectors mark the occupied quotients and the ends of runs), and has a counter for each remainder. Reading a filter
in order gives its fingerprints in order; so filters merge by their sorted remainders, the counts of equal ones are added, and
nothing is lost: a merged filter is the filter of all rows.

Fingerprints with a count above one are routed to byte verification: texts are grouped by fingerprint and by the whole normalised
text, which compares bytes, after combining copies inside each input partition. A hot text is thus one row a partition. The
groups go back to the rows by fingerprint and SHA-256; that no two different texts of the groups share both is checked.

Skew: fingerprints that hold more than a HOT_SHARE-th of all rows are at most HOT_SHARE in number, and only their groups are
broadcast; rows of other groups are shuffled by fingerprint. Routed fingerprints are broadcast up to ROUTED_ROWS by count; beyond
it copies are combined first and fingerprints are joined by a shuffle.

Defined cases: null and empty texts are equal. Of equal texts the row with the largest id stays, rows with a null id only if no
other is there; rows that repeat both id and text stay or go together. Very long texts are read and compared whole. Columns of
any other name pass through; keep_id, group_size, kept and text_sha256 are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, ensure_checkpoint_dir, input_tasks, written

#: Rows of the routed fingerprints that may be broadcast (8 bytes each), and the most groups that may be called hot.
ROUTED_ROWS = 1 << 20
HOT_SHARE = 1024

OUT = ("keep_id", "group_size", "kept", "text_sha256")


@dataclass
class QuotientFilter:
    """Distinct fingerprints of ``quotient_bits + remainder_bits`` bits with their counts.

    ``occupied`` has a bit for each quotient, ``run_ends`` one for each remainder; remainders of one quotient are a run in
    ascending order, and runs follow each other in the order of their quotients.
    """

    quotient_bits: int
    remainder_bits: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """Of distinct, ascending fingerprints below 2^bits. About as many quotients as fingerprints."""
        q = min(bits, max(1, int(len(fingerprints)).bit_length()))
        r = bits - q
        quotient = _shift(fingerprints, r).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        run_ends = np.append(np.diff(quotient) > 0, True)[: len(quotient)]
        return cls(q, r, occupied, run_ends, fingerprints & _mask(r), counts)

    def fingerprints(self) -> np.ndarray:
        """Ascending, as they went in: the n-th run belongs to the n-th occupied quotient."""
        run = np.cumsum(self.run_ends) - self.run_ends
        quotient = np.flatnonzero(self.occupied).astype(np.uint64)[run]
        return (_shift(quotient, -self.remainder_bits) if len(quotient) else quotient) | self.remainders

    def count(self, asked: np.ndarray) -> np.ndarray:
        """How often each fingerprint went in: rank of its quotient gives the run, select its bounds, bisection the remainder."""
        quotient, rest = _shift(asked, self.remainder_bits).astype(np.int64), asked & _mask(self.remainder_bits)
        run = np.cumsum(self.occupied)[quotient] - 1
        ends = np.flatnonzero(self.run_ends)
        low = np.where(run > 0, ends[run - 1] + 1, 0) if len(ends) else np.zeros(len(asked), np.int64)
        high = ends[run] + 1 if len(ends) else low
        while (open_ := (high - low) > 1).any():
            middle = (low + high) // 2
            right = open_ & (self.remainders[np.minimum(middle, len(self.remainders) - 1)] <= rest)
            low, high = np.where(right, middle, low), np.where(open_ & ~right, middle, high)
        there = self.occupied[quotient] & (high > low)
        at = np.minimum(low, max(0, len(self.remainders) - 1))
        return np.where(there & (self.remainders[at] == rest), self.counts[at], 0) if len(self.remainders) else np.zeros(len(asked), np.int64)

    def pack(self) -> bytes:
        width = max(1, -(-self.remainder_bits // 8))
        rest = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([self.quotient_bits, self.remainder_bits, len(self.remainders), int((self.counts > 1).sum())], "<i8")
        more = np.flatnonzero(self.counts > 1)
        parts = [head, np.packbits(self.occupied), np.packbits(self.run_ends), np.ascontiguousarray(rest), more.astype("<i4"), self.counts[more].astype("<i8")]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, data: bytes) -> QuotientFilter:
        q, r, n, m = (int(v) for v in np.frombuffer(data, "<i8", 4))
        width, at = max(1, -(-r // 8)), 32
        take = lambda size: slice(at, at + size)
        occupied = np.unpackbits(np.frombuffer(data[take(-(-(1 << q) // 8))], np.uint8), count=1 << q).astype(bool)
        at += -(-(1 << q) // 8)
        ends = np.unpackbits(np.frombuffer(data[take(-(-n // 8))], np.uint8), count=n).astype(bool)
        at += -(-n // 8)
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(data[take(n * width)], np.uint8).reshape(n, width)
        at += n * width
        counts = np.ones(n, np.int64)
        more = np.frombuffer(data[take(4 * m)], "<i4")
        at += 4 * m
        counts[more] = np.frombuffer(data[take(8 * m)], "<i8")
        return cls(q, r, occupied, ends, rest.reshape(-1).view("<u8").copy(), counts)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _shift(v: np.ndarray, bits: int) -> np.ndarray:
    """Right by ``bits``, left if negative; shifts by 64 are not defined in numpy."""
    v = v.astype(np.uint64)
    if abs(bits) >= 64:
        return np.zeros_like(v)
    return v >> np.uint64(bits) if bits >= 0 else v << np.uint64(-bits)


def merge(filters: list[QuotientFilter]) -> QuotientFilter:
    """The filter of all rows of ``filters``: sorted fingerprints are merged, counts of equal ones added."""
    bits = filters[0].quotient_bits + filters[0].remainder_bits
    every = np.concatenate([f.fingerprints() for f in filters])
    order = np.argsort(every, kind="stable")  # merges the ascending parts
    every, counts = every[order], np.concatenate([f.counts for f in filters])[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return QuotientFilter.build(every[first], np.add.reduceat(counts, first) if len(first) else counts, bits)


def _normal(text: Column) -> Column:
    """A-Z lower-cased. A text of one byte a character is ASCII, for which lower() does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def _ranges(tasks: int, bits: int) -> int:
    """Bits of a fingerprint that name its range: two to four ranges a task."""
    return min(bits - 1, (tasks - 1).bit_length() + 1)


def repeated_fingerprints(rows: DataFrame, bits: int) -> DataFrame:
    """rows(fp bigint, unsigned in ``bits`` bits) to (fp, n): those with a count n above one."""
    tasks = input_tasks(rows.sparkSession)
    top = _ranges(tasks, bits)
    low = bits - top

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def settle():
            nonlocal fps, counts, waiting
            new, n = np.unique(np.concatenate([*waiting, np.zeros(0, np.uint64)]), return_counts=True)
            both = np.concatenate([fps, new])
            fps, at = np.unique(both, return_inverse=True)
            counts, waiting = np.bincount(at, np.concatenate([counts, n]), len(fps)).astype(np.int64), []

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, waiting)) >= 1 << 20:
                settle()
        settle()
        part = _shift(fps, low).astype(np.int64)
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        packed = [QuotientFilter.build(fps[a:b] & _mask(low), counts[a:b], low).pack() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=["part", "filter"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Filters come sorted by range; a merged one is kept for the range that is open, and a few that wait."""
        at, open_ = None, []
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != at and open_:
                    yield told(at, open_)
                    open_ = []
                at = part
                open_.append(QuotientFilter.unpack(data.as_py()))
                if len(open_) >= 64:
                    open_ = [merge(open_)]
        if open_:
            yield told(at, open_)

    def told(part: int, filters: list[QuotientFilter]) -> pa.RecordBatch:
        whole = merge(filters)
        some = whole.counts > 1
        fps = whole.fingerprints()[some] | _shift(np.array([part], np.uint64), -low)
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(whole.counts[some])], names=["fp", "n"])

    filters = rows.select("fp").mapInArrow(build, "part int, filter binary")
    return filters.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(join, "fp bigint, n bigint")


def exact_groups(docs: DataFrame, text: Column | None = None, id_: Column | None = None, bits: int = 64) -> DataFrame:
    """Add keep_id, group_size, kept and text_sha256 to every row of ``docs``. ``bits`` shortens fingerprints, for tests of collisions."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    text, id_ = F.col("text") if text is None else text, F.col("doc_id") if id_ is None else id_
    others = [c for c in docs.columns if c not in OUT]
    norm = _normal(F.coalesce(text, F.lit("")))
    fp = F.shiftrightunsigned(F.xxhash64(norm), 64 - bits) if bits < 64 else F.xxhash64(norm)
    rows = docs.select(fp.alias("fp"), id_.alias("id"), norm.alias("norm"))

    routed = written(repeated_fingerprints(rows.select("fp"), bits))
    n_routed = routed.count()
    seen = rows.join(F.broadcast(routed.select("fp")), "fp", "left_semi") if n_routed <= ROUTED_ROWS else rows
    same = seen.groupBy("fp", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    groups = written(same.where("n > 1").select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "n"))
    discard(routed)
    facts = groups.agg(F.count("*").alias("n"), F.sum("n").alias("rows")).first()
    if groups.groupBy("fp", "sha").count().where("count > 1").limit(1).count():
        raise ValueError("two different texts share fingerprint and SHA-256")

    # Groups of more than rows / HOT_SHARE rows: at most HOT_SHARE of them.
    limit = max(1, (facts["rows"] or 0) // HOT_SHARE)
    hot = groups.where(F.col("n") > limit)
    hot = hot.select(F.col("fp").alias("hot_fp"), F.col("sha").alias("hot_sha"), F.col("keep_id").alias("hot_id"), F.col("n").alias("hot_n"))
    cold = groups.where(F.col("n") <= limit).select(F.col("fp").alias("cold_fp"), F.col("sha").alias("cold_sha"), F.col("keep_id").alias("cold_id"), F.col("n").alias("cold_n"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc"), fp.alias("fp"), id_.alias("id"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    asked = keyed.join(F.broadcast(hot), (F.col("fp") == F.col("hot_fp")) & (F.col("sha") == F.col("hot_sha")), "left")
    # A hot row has its answer; the shuffle deals it out by its id, and its null digest meets no group.
    asked = asked.withColumns({"k": F.when(F.col("hot_fp").isNull(), F.col("fp")).otherwise(F.xxhash64("id", "fp")), "s": F.when(F.col("hot_fp").isNull(), F.col("sha"))})
    found = asked.join(cold, (F.col("k") == F.col("cold_fp")) & (F.col("s") == F.col("cold_sha")), "left")
    size = F.coalesce("hot_n", "cold_n", F.lit(1))
    keep = F.when(F.col("hot_n").isNotNull(), F.col("hot_id")).when(F.col("cold_n").isNotNull(), F.col("cold_id")).otherwise(F.col("id"))
    return found.select(*[F.col(f"doc.`{c}`") for c in others], keep.alias("keep_id"), size.cast("bigint").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: Column | None = None, id_: Column | None = None) -> DataFrame:
    """``docs`` without the rows whose text an equal row with a larger id has; all columns pass."""
    marked = exact_groups(docs.select(F.struct("*").alias("row"), (F.col("text") if text is None else text).alias("text"), (F.col("doc_id") if id_ is None else id_).alias("doc_id")))
    return marked.where("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])

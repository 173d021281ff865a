"""Runs of periodic words, and texts without the repeats in them.

A run is a stretch of consecutive words that repeats with a smallest period q, has at least twice q and ``least`` words, and that
no neighbouring word extends. Each text is judged by itself, so nothing is shuffled.

Words get names (equal words, equal names). Naming by powers of two follows Karp, Miller and Rosenberg: two stretches of 2^(k+1)
words are equal if their halves' names of level k are, so a level's names number the distinct pairs of the level before. Levels end
where no two names are equal any more: no longer stretch repeats. The longest common extension of two positions, to either side,
goes down the levels and takes a step of 2^k words wherever names of level k agree.

Candidates stand on a grid: a run of period p covers two periods, so it holds a multiple i of p and i + p, whose words are equal.
Only such pairs are extended both ways; a pair whose extensions span a period gives a maximal stretch. The same stretch is found from
many pairs, and for multiples of its smallest period, which is kept (by Fine and Wilf a stretch has no other periods of half its length).
There are n / p pairs for a period p, so n log n for all; they are taken in slabs of bounded size. Texts of a batch share the
arrays, with a word of its own between two texts, so that no extension crosses.

Defined cases: a null or empty text, or one of spaces only, has no words and no runs, and its collapsed text is empty. Repeated rows are
judged alike; columns of any other name pass, ``runs`` and ``collapsed`` are replaced. Runs of equal start and length do not occur
twice. A long text takes about 8 bytes a word and level.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_slices

LEAST = 12
#: Words of texts that share arrays, and grid pairs of a slab.
SHARED_WORDS = 1 << 16
SLAB = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def power_names(names: np.ndarray) -> list[np.ndarray]:
    """names[i] of single words to a list of levels; level k names the 2^k words from i on. Stretches that pass the end have names of their own."""
    levels, size, n = [names], 1, len(names)
    while size < n:
        last = levels[-1].astype(np.int64)
        after = np.append(last[size:], last.max() + 1 + np.arange(size))
        _, name = np.unique(last * (after.max() + 1) + after, return_inverse=True)
        if name.max() + 1 == n:
            break
        levels.append(name.astype(np.int32))
        size *= 2
    return levels


def common_ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on and from j > i on are equal."""
    i, j, n = i.copy(), j.copy(), len(levels[0])
    start = i.copy()
    for k in reversed(range(len(levels))):
        inside = j < n
        same = inside & (levels[k][np.where(inside, i, 0)] == levels[k][np.where(inside, j, 0)])
        i += same.astype(np.int64) << k
        j += same.astype(np.int64) << k
    return i - start


def common_behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i and before j > i are equal."""
    i, j = i.copy(), j.copy()
    start = i.copy()
    for k in reversed(range(len(levels))):
        inside = i >= 1 << k
        back = np.where(inside, i - (1 << k), 0)
        same = inside & (levels[k][back] == levels[k][np.where(inside, j - (1 << k), 0)])
        i -= same.astype(np.int64) << k
        j -= same.astype(np.int64) << k
    return start - i


def _grid(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of grid pairs of texts that start at ``first`` with ``size`` words, in slabs."""
    text = np.repeat(np.arange(len(size)), size // 2)
    period = np.arange(len(text)) - np.repeat(np.cumsum(size // 2) - size // 2, size // 2) + 1
    pairs = (size[text] - 1) // period
    upto = np.cumsum(pairs)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLAB, side="right")))
        n, p = pairs[at:end], period[at:end]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(p, n)
        yield np.repeat(first[text[at:end]], n) + place * p, p
        at = end


def runs_of(names: np.ndarray, first: np.ndarray, size: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; ``names`` has a name of its own before, between and after the texts."""
    levels = power_names(names)
    found = [np.zeros((3, 0), np.int64)]
    for i, p in _grid(first, size):
        some = names[i] == names[i + p]
        i, p = i[some], p[some]
        ahead, behind = common_ahead(levels, i, i + p), common_behind(levels, i, i + p)
        some = (ahead + behind >= p) & (ahead + behind + p >= least)
        found.append(np.unique(np.stack([i - behind, ahead + behind + p, p])[:, some], axis=1))
    start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    once = np.append(True, (np.diff(start) > 0) | (np.diff(length) > 0))[: len(start)]
    start, length, period = start[once], length[once], period[once]
    order = np.lexsort([period, start])
    return start[order], length[order], period[order]


def repeats_of(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _judge(texts: list[bytes | None], least: int) -> Iterator[tuple[list, bytes]]:
    """(runs, collapsed text) of each text; the texts share arrays."""
    words = [(t or b"").split() for t in texts]  # at spaces and tabs to carriage returns
    size = np.fromiter(map(len, words), np.int64, len(words))
    every = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size + np.arange(1, len(words) + 1)
    names = np.arange(size.sum() + len(words) + 1, dtype=np.int32) + len(every)
    inside = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(every))
    names[inside] = every
    start, length, period = runs_of(names, first, size, least)
    gone = repeats_of(len(names), start, length, period)
    cut = np.searchsorted(start, np.append(first, len(names)))
    for k, ws in enumerate(words):
        a, b = cut[k], cut[k + 1]
        runs = [{"start": s, "length": n, "period": p} for s, n, p in zip((start[a:b] - first[k]).tolist(), length[a:b].tolist(), period[a:b].tolist())]
        yield runs, b" ".join(compress(ws, ~gone[first[k] : first[k] + len(ws)]) if runs else ws)


def find_runs(docs: DataFrame, text: Column | None = None, least: int = LEAST) -> DataFrame:
    """Add ``runs`` (by start, then period, words numbered from 0) and ``collapsed`` (words that repeat within a run left out, joined by one space) to every row."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf(f"struct<runs:{RUNS},collapsed:string>")
    def of(column: pa.Array) -> pa.Array:
        runs, kept = [], []
        for _, part in text_slices(column):
            open_, words = [], 0
            for t in part.cast(pa.large_binary()).to_pylist():
                n = (t or b"").count(b" ") + 1
                if open_ and words + n > SHARED_WORDS:
                    judged = list(_judge(open_, least))
                    runs += [r for r, _ in judged]
                    kept += [c for _, c in judged]
                    open_, words = [], 0
                open_.append(t)
                words += n
            judged = list(_judge(open_, least))
            runs += [r for r, _ in judged]
            kept += [c for _, c in judged]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["runs", "collapsed"])

    text = F.col("text") if text is None else text
    others = [c for c in docs.columns if c not in ("runs", "collapsed")]
    said = "said" + "_" * max(map(len, docs.columns))  # longer than any other name
    judged = docs.select(*[F.col(f"`{c}`") for c in others], of(text).alias(said))
    return judged.select(*[F.col(f"`{c}`") for c in others], F.col(f"{said}.runs").alias("runs"), F.col(f"{said}.collapsed").alias("collapsed"))

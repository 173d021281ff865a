"""Benchmark decontamination by pigeonhole edit matching.

Items and texts are lower-cased and their runs of white space become one blank. An item of m characters
may occur in a text with up to k = floor(rate * m) edits. It is cut into k + 1 pieces, one of which any such
occurrence holds unchanged: an Aho-Corasick automaton finds all pieces in a text, hits on neighbouring
diagonals share a window, windows that lack too many of the item's letter triples for its budget are passed over, and Myers' bit-parallel distance decides, for many windows at once.

Items reach the executors in blocks of bounded size, one pass over the texts a block, however large the
benchmark is; a block's matches are written before the next one is sent, so that one block is in memory at a time. An item's bit
masks take room by its own length. Texts are read whole.

Items are searched whatever their length. One that is too short for an edit (below 1 / rate characters) is found where it stands
unchanged between word bounds.

Defined cases: null or empty texts match nothing; null and empty items and items without an id match nothing; very long items are
matched whole, an item longer than a block is a block of its own; equal items are reported each under
its own id, a repeated item id by its best match; repeated documents are each reported. An
empty table on either side gives no matches. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written

#: Characters of items in a block.
BLOCK_CHARS = 4_000_000
_WINDOWS = 8192
_TRIPLES = 4096


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """(start, end) of budget + 1 pieces that differ in length by one at most."""
    cut = [round(i * length / (budget + 1)) for i in range(budget + 2)]
    return list(zip(cut, cut[1:]))


def _triples(code: np.ndarray) -> np.ndarray:
    """Hashed numbers of all runs of three letters."""
    code = code.astype(np.int64)
    return (code[:-2] * 961 + code[1:-1] * 31 + code[2:]) & (_TRIPLES - 1)


class Matcher:
    """A block of normalised items, ready for matching."""

    def __init__(self, items: list[str], rate: float) -> None:
        self.length = np.array([len(t) for t in items], np.int64)
        self.budget = (rate * self.length + 1e-9).astype(np.int64)
        self.exact = self.budget == 0
        self.words = (self.length + 63) // 64
        where = defaultdict(list)
        for i, t in enumerate(items):
            for a, b in pieces(len(t), int(self.budget[i])):
                where[t[a:b]].append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        letters = sorted(set("".join(items)))
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        # Masks of item i: a row of its own words for each letter, from ``start[i]`` on.
        size = self.words * (len(letters) + 1)
        self.start = np.cumsum(size) - size
        self.masks = np.zeros(int(size.sum()), np.uint64)
        for i, t in enumerate(items):
            at = np.arange(len(t))
            code = self.number[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
            np.bitwise_or.at(self.masks, self.start[i] + code * self.words[i] + at // 64, np.uint64(1) << (at % 64).astype(np.uint64))

        self.triples = [_triples(self.number[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]) for t in items]

    def plausible(self, item: int, triples: np.ndarray) -> bool:
        """An edit breaks three of an item's letter triples at most; the others must be in the window."""
        here = np.zeros(_TRIPLES, bool)
        here[triples] = True
        own = self.triples[item]
        return len(own) - np.count_nonzero(here[own]) <= 3 * int(self.budget[item])

    def windows(self, text: str) -> list[tuple[int, int, int]]:
        """(item, from, to) of the stretches where an occurrence may lie."""
        diagonals = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for i, a in places:
                if not self.exact[i]:
                    diagonals[i].add(end + 1 - size - a)
        out = []
        for i, found in diagonals.items():
            k, m, first, last = int(self.budget[i]), int(self.length[i]), None, None
            for d in sorted(found):
                if first is not None and d - first > m:
                    out.append((i, first - k, last + m + k))
                    first = None
                first, last = d if first is None else first, d
                if len(found) == 1:
                    break
            out.append((i, first - k, last + m + k))
        return [(i, max(0, a), min(len(text), b)) for i, a, b in out]

    def whole(self, text: str) -> dict[int, int]:
        """Items that match exactly, between word bounds: item to the first end."""
        out = {}
        if self.exact.any():
            for end, (size, places) in self.automaton.iter(text):
                for i, _ in places:
                    if self.exact[i] and i not in out and text[end + 1 : end + 2] in ("", " ") and text[max(0, end - size) : end + 1 - size] in ("", " "):
                        out[i] = end + 1
        return out

    def distances(self, item: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of each item to any substring of its row of letters, and where that ends.

        Myers' algorithm over 64-bit words, one text column at a time for all rows. Letter 0 matches nothing.
        """
        own, words = self.words[item], int(self.words[item].max())
        n, last, one = len(item), own - 1, np.uint64(1)
        top = np.full((n, words), 63, np.uint64)
        top[np.arange(n), last] = ((self.length[item] - 1) % 64).astype(np.uint64)
        plus, minus = np.full((n, words), ~np.uint64(0)), np.zeros((n, words), np.uint64)
        score = self.length[item].copy()
        best, at = score.copy(), np.zeros(n, np.int64)
        for c in range(columns.shape[1]):
            row = self.start[item] + columns[:, c].astype(np.int64) * own
            up, down = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for w in range(words):
                pv, mv = plus[:, w], minus[:, w]
                eq = np.where(w < own, self.masks[row + np.minimum(w, last)], np.uint64(0))
                xv = eq | mv
                eq = eq | down
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                new_up, new_down = (ph >> top[:, w]) & one, (mh >> top[:, w]) & one
                end = last == w
                score[end] += new_up[end].astype(np.int64) - new_down[end].astype(np.int64)
                ph, mh = (ph << one) | up, (mh << one) | down
                plus[:, w], minus[:, w] = mh | ~(xv | ph), ph & xv
                up, down = new_up, new_down
            better = score < best
            best[better], at[better] = score[better], c + 1
        return best, at

    def match(self, texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int]]:
        """(text number, item) to (edits, end), the least edits and then the first end."""
        found, waiting = {}, []

        def settle() -> None:
            waiting.sort(key=lambda w: (self.length[w[1]] // 64, len(w[3])))
            for a in range(0, len(waiting), 1024):
                some = waiting[a : a + 1024]
                item = np.array([w[1] for w in some])
                grid = np.zeros((len(some), max(len(w[3]) for w in some)), np.uint16)
                for r, w in enumerate(some):
                    grid[r, : len(w[3])] = w[3]
                edits, end = self.distances(item, grid)
                for w, e, x, k in zip(some, edits.tolist(), end.tolist(), self.budget[item].tolist()):
                    if e <= k:
                        key, new = (w[0], w[1]), (e, w[2] + x)
                        found[key] = min(found.get(key, new), new)
            waiting.clear()

        for number, raw in enumerate(texts):
            text = normal(raw)
            places = self.windows(text) if text else []
            for i, end in (self.whole(text) if text else {}).items():
                found[number, i] = (0, end)
            if places:
                code = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
                triples = _triples(code)
                for i, a, b in places:
                    if not self.plausible(i, triples[a : max(a, b - 2)]):
                        continue
                    waiting.append((number, i, a, code[a:b]))
                    if len(waiting) >= _WINDOWS:
                        settle()
        settle()
        return found


@lru_cache(maxsize=1)
def _matcher(items: tuple[str, ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def _search(block, rate: float, kind: pa.DataType):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = block.value
        matcher = _matcher(items, rate)
        for batch in batches:
            found = {}
            for at, part in text_slices(batch.column("text")):
                found |= {(at + n, i): v for (n, i), v in matcher.match(part.to_pylist()).items()}
            rows = pa.array([n for n, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    pa.array([ids[i] for _, i in found], kind),
                    pa.array([e for e, _ in found.values()], pa.int32()),
                    pa.array([x for _, x in found.values()], pa.int64()),
                    pa.array([len(items[i]) for _, i in found], pa.int32()),
                ],
                names=["doc_id", "item_id", "edits", "end", "item_chars"],
            )

    return of


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) against benchmark(item_id, text): doc_id, item_id, edits, end (in the normalised text), item_chars.

    One row per document row and item found in it.
    """
    spark = docs.sparkSession
    usable = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    kind = usable.select("item_id").limit(0).toArrow().schema.field(0).type
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, edits int, end bigint, item_chars int"
    out = None
    for b in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        rows = sorted({(r.item_id, t) for r in rows for t in [normal(r.text)] if t})
        if rows:
            block = spark.sparkContext.broadcast(([i for i, _ in rows], tuple(t for _, t in rows)))
            found = docs.where("text is not null").select("doc_id", "text").mapInArrow(_search(block, rate, kind), schema)
            if blocks > 1:
                found = written(found)
                block.unpersist()
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out


def best_matches(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document id and item id: the fewest edits and the first end with them."""
    best = F.min(F.struct("edits", "end", "item_chars")).alias("best")
    return contaminated(docs, benchmark, **how).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in which no item is found; rows without an id are judged by a key of their own."""
    key = F.xxhash64("doc_id", "text")
    bad = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("key")).distinct()
    return docs.select(F.struct("*").alias("doc"), key.alias("key")).join(bad, "key", "left_anti").select("doc.*")

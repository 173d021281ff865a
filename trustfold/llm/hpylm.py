"""Language-model scoring with a hierarchical Pitman-Yor model over word bigrams.

Words are the customers of context restaurants; the context of a word is its predecessor, hashed to one of
2**16 restaurants. All context restaurants share one parent, the unigram restaurant, whose customers
are their tables, and whose own parent is uniform over the known words and one unknown word. Seating is
sampled by Gibbs sweeps over the numbers of tables: in every sweep each (context, word) pair's number is drawn given the
other pairs' tables and the parent without its own. Up to 16 customers it is drawn from its conditional distribution (generalised
Stirling numbers); more customers sit down one by one, and from 16 on in
blocks of an eighth of those seated, with the number of new tables drawn binomially. A pair's seating needs
only the totals of its context from outside, so sweeps run side by side in all partitions, with the
totals of the round before; within a sweep pairs do not see each other's new tables. Probabilities are averaged over the last sweeps and every sample is used with
its own totals, so each of them sums to one over the known words and the unknown one.

Layout: three passes over the texts and one shuffle. Pass one finds the words that make up a 256th of all
tokens (256 of them at most; routing only). Pass two sends all other tokens as packed arrays to the partition of their
word, where counts, seating and each document's postings stand together; the frequent words' counts by context
(256 x 2**16 at most) are summed by key and seated on the driver. Pass three scores the frequent words in
place with the driver's table, and sums meet by document. No partition holds more than its words, and no
frequent word is dealt to one task.

Defined cases: a null text is empty and has the end token only; repeated rows (equal id and text) are scored
alike and all returned; a null id is learned from and not held out; with nothing to learn from all words are
unknown. Words are identified by 64-bit hashes, rows by a 64-bit hash of id and text. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, byte_table, input_tasks, release, space_table, word_bounds, written

CONTEXT_BITS = 16
CONTEXTS = 1 << CONTEXT_BITS
HEAVY = 256
_BLOCK = 256
_CHUNK = 1 << 16
_BATCH = 4 << 20
_U = np.uint64
_LETTER = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.int64).view(_U) * _U(2) + _U(1)
_R = _U(0x5851F42D4C957F2D)
_R_INV = _U(pow(int(_R), -1, 1 << 64))
_END, _BEGIN = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)
_LOWER, _SPACE = byte_table(), space_table()
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, _CHUNK + (_CHUNK >> 1))
        step = np.full(size, base, _U)
        step[0] = 1
        have = _powers[name] = np.multiply.accumulate(step)
    return have[:n]


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    return h ^ (h >> _U(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, each text's followed by the end token; tokens per text."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    starts, ends = word_bounds(data, _SPACE)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTER[data] * _power("r", _R, len(data)), out=total[1:])
    words = _finish((total[ends] - total[starts]) * _power("i", _R_INV, len(data))[starts])
    stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(starts, stop)
    count = np.diff(np.concatenate([[0], upto])) + 1
    out = np.full(len(words) + len(texts), _END, _U)
    last = np.cumsum(count) - 1
    is_word = np.ones(len(out), bool)
    is_word[last] = False
    out[is_word] = words
    return out, count


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, context number, text number) of all tokens, and nothing kept of the text."""
    texts = [t or b"" for t in texts]
    parts, counts, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
            size += len(texts[end])
            end += 1
        h, n = word_hashes(texts[at:end])
        parts.append(h)
        counts.append(n)
        at = end
    h, n = np.concatenate(parts), np.concatenate(counts)
    before = np.concatenate([[_BEGIN], h[:-1]])
    before[np.cumsum(n)[:-1]] = _BEGIN
    context = (before * _U(0x9FB21C651E98DF25)) >> _U(64 - CONTEXT_BITS)
    return h, context.astype(np.uint16), np.repeat(np.arange(len(texts), dtype=np.uint32), n)


def _pieces(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    """Columns of a batch in slices of limited text size; the first name is the text."""
    column = batch.column(names[0])
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    rest = [batch.column(c).to_numpy(zero_copy_only=False) for c in names[1:]]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _BATCH, side="right")))
        yield (column.slice(at, end - at).cast(pa.large_binary()).to_pylist(), *[c[at:end] for c in rest])
        pa.default_memory_pool().release_unused()
        at = end


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for (texts,) in _pieces(batch, ["text"]):
            h, _, _ = tokens(texts)
            word, count = np.unique(h, return_counts=True)
            most = count * (2 * HEAVY) >= len(h)
            # The total goes along under a null word.
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *word[most].view(np.int64).tolist()], pa.int64()), pa.array([len(h), *count[most].tolist()], pa.int64())], names=["word", "n"]
            )


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of words with a 256th of the tokens, counting the pieces where they are frequent."""
    rows = docs.select("text").mapInArrow(_frequent, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.col("n").desc()).limit(HEAVY + 1).collect()
    total = next((r.n for r in top if r.word is None), 0)
    return np.sort(np.array([r.word for r in top if r.word is not None and r.n * HEAVY >= total], np.int64).view(_U))


def _find(heavy: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position among ``heavy`` and whether it is there."""
    if not len(heavy):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
    return at, heavy[at] == h


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    return b"".join([head.tobytes(), *[a.tobytes() for a in arrays]])


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    size, at, out = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1), []
    for s, kind in zip(size.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, s // np.dtype(kind).itemsize, at))
        at += s
    return out


_COUNTS = (np.uint16, np.uint16, np.uint32)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def _light(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, word hashes, run lengths, contexts, 2 * text number + learn) of one piece of the texts."""
    n = int(np.frombuffer(blob, np.int64, 1, 8 * 4)[0]) // 2  # contexts take two bytes each
    wide = int(np.frombuffer(blob, np.int64, 1, 8 * 5)[0]) // max(n, 1) == 4
    piece, h, runs, context, doc = _unpack(blob, np.int64, _U, np.uint32, np.uint16, np.uint32 if wide else np.uint16)
    return int(piece[0]), h, runs, context, doc


def _deal(heavy: np.ndarray, parts: int):
    """Texts to packed arrays by partition.

    Kind 0: light tokens by word; kind 1: frequent words' training counts by (word, context block); kind
    2: the row keys of a piece of the texts, which is named by a hash of them.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, row, learn in _pieces(batch, ["text", "row", "learn"]):
                h, context, doc = tokens(texts)
                at, known = _find(heavy, h)
                row = row.astype(np.int64)
                piece = np.frombuffer(xxhash.xxh3_64_digest(row.tobytes()), np.int64)
                part, kind, blob = [int(abs(int(piece[0])) % parts)], [2], [_pack(piece, row)]
                counted = known & learn[doc]
                pair, n = np.unique((at[counted] << CONTEXT_BITS) | context[counted], return_counts=True)
                slot = (((pair >> 11) * 0x9E3779B1) & 0xFFFFFFFF) * parts >> 32
                for p in np.unique(slot).tolist():
                    here = slot == p
                    part.append(p)
                    kind.append(1)
                    blob.append(_pack((pair[here] >> CONTEXT_BITS).astype(np.uint16), (pair[here] & (CONTEXTS - 1)).astype(np.uint16), n[here].astype(np.uint32)))
                h, context, doc = h[~known], context[~known], doc[~known]
                order = np.argsort(h, kind="stable")
                h, context = h[order], context[order]
                doc = _narrow(2 * doc[order] + learn[doc[order]])
                slot = ((h >> _U(32)) * _U(parts)) >> _U(32)
                cut = np.searchsorted(slot, np.arange(parts + 1, dtype=_U))
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    a, b = cut[p], cut[p + 1]
                    first = np.flatnonzero(np.concatenate([[True], h[a + 1 : b] != h[a : b - 1]]))
                    runs = np.diff(np.concatenate([first, [b - a]])).astype(np.uint32)
                    part.append(p)
                    kind.append(0)
                    blob.append(_pack(piece, h[a:b][first], runs, context[a:b], doc[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"]
                )

    return of


def _gather(blobs: list[bytes]) -> tuple[bytes, bytes]:
    """One partition's light tokens: (word, context, training count) of all pairs, and postings by pair."""
    got = [_light(b) for b in blobs]
    _, word = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
    word = np.repeat(word, np.concatenate([g[2] for g in got])).astype(_U)
    key = (word << _U(CONTEXT_BITS)) | np.concatenate([g[3] for g in got])
    doc = np.concatenate([g[4].astype(np.uint32) for g in got])
    piece = np.repeat(np.arange(len(got), dtype=np.uint32), [len(g[4]) for g in got])
    order = np.argsort(key)
    key, doc, piece = key[order], doc[order], piece[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pair = key[first]
    count = np.add.reduceat(doc & np.uint32(1), first, dtype=np.uint32)
    runs = np.diff(np.concatenate([first, [len(key)]])).astype(np.uint32)
    stats = _pack((pair >> _U(CONTEXT_BITS)).astype(np.uint32), (pair & _U(CONTEXTS - 1)).astype(np.uint16), count)
    doc >>= np.uint32(1)
    wide = np.array([piece.max() >= 1 << 16, doc.max() >= 1 << 16], np.int64)
    return stats, _pack(wide, np.array([g[0] for g in got], np.int64), runs, _narrow(piece), _narrow(doc))


def _postings(posts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece names, postings per pair, piece number, text number)."""
    wide = np.frombuffer(posts, np.int64, 2, 8 * 6)
    kinds = [np.uint32 if w else np.uint16 for w in wide]
    _, names, runs, piece, doc = _unpack(posts, np.int64, np.int64, np.uint32, *kinds)
    return names, runs, piece, doc


def _sum_counts(blobs: list[bytes]) -> bytes:
    got = [_unpack(b, *_COUNTS) for b in blobs]
    pair = np.concatenate([(g[0].astype(np.int64) << CONTEXT_BITS) | g[1] for g in got])
    pair, at = np.unique(pair, return_inverse=True)
    n = np.bincount(at, np.concatenate([g[2] for g in got]).astype(np.float64)).astype(np.uint32)
    return _pack((pair >> CONTEXT_BITS).astype(np.uint16), (pair & (CONTEXTS - 1)).astype(np.uint16), n)


def _collate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, kind): one row of packed arrays for each."""
    now, held = None, []

    def emit() -> pa.RecordBatch:
        if now[1] == 0:
            stats, posts = _gather(held)
        elif now[1] == 1:
            stats, posts = _sum_counts(held), b""
        else:
            stats, posts = b"", _pack(*[x for b in dict.fromkeys(held) for x in _unpack(b, np.int64, np.int64)])
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([stats], pa.binary()), pa.array([posts], pa.binary())], names=["part", "kind", "stats", "posts"]
        )

    for batch in batches:
        for p, k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (p, k) != now:
                if held:
                    yield emit()
                now, held = (p, k), []
            held.append(blob)
    if held:
        yield emit()


@dataclass
class Totals:
    """What a sweep needs from outside its partition. by_context: customers, then tables of each sample."""

    customers: np.ndarray
    tables: np.ndarray  # samples x contexts
    root_customers: np.ndarray  # per sample
    root_tables: np.ndarray
    train_tokens: int
    known_words: int
    discount: float
    root_discount: float
    strength: float = 8.0
    root_strength: float = 8.0


_EXACT = 16


@lru_cache(maxsize=64)
def _ways(discount: float) -> np.ndarray:
    """Log generalised Stirling numbers: in how many weighted ways c customers sit at t tables, c up to _EXACT."""
    out = np.zeros((_EXACT + 1, _EXACT + 1))
    out[0, 0] = 1
    for c in range(_EXACT):
        for t in range(1, c + 2):
            out[c + 1, t] = out[c, t - 1] + max(0.0, c - discount * t) * out[c, t]
    with np.errstate(divide="ignore"):
        return np.log(out)


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Number of tables of each dish, given everyone else. others: strength + discount * the restaurant's other tables.

    Up to _EXACT customers the number is drawn from its conditional distribution: t tables have the weight of the ways to sit at t tables
    times (others + discount * i) * parent for each of them. More customers sit down one by one, and from 16 on in blocks of an eighth.
    """
    customers = customers.astype(np.int64)
    tables = (customers > 0).astype(np.int64)
    ways = _ways(float(discount))
    small = np.flatnonzero((customers > 1) & (customers <= _EXACT))
    small = small[np.argsort(customers[small], kind="stable")]
    cut = np.searchsorted(customers[small], np.arange(2, _EXACT + 2))
    for c, a, b in zip(range(2, _EXACT + 1), cut[:-1].tolist(), cut[1:].tolist()):
        at = small[a:b]
        if not len(at):
            continue
        i = np.arange(c)
        steps = np.log((others[at, None] + discount * i) * parent[at, None])
        weight = np.cumsum(steps, axis=1) + ways[c, 1 : c + 1]
        weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        tables[at] = 1 + (weight < rng.random(len(at))[:, None] * weight[:, -1:]).sum(axis=1)
    at = np.flatnonzero(customers > _EXACT)
    n, t = np.ones(len(at), np.int64), np.ones(len(at), np.int64)
    goal, a, p0 = customers[at], others[at], parent[at]
    while len(at):
        step = np.minimum(goal - n, np.maximum(1, np.where(n >= 16, n >> 3, 1)))
        weight = (a + discount * t) * p0
        p = weight / (weight + n - discount * t)
        single = step == 1
        new = np.zeros(len(at), np.int64)
        new[single] = rng.random(int(single.sum())) < p[single]
        if not single.all():
            new[~single] = rng.binomial(step[~single], p[~single])
        t += new
        n += step
        done = n >= goal
        if done.any():
            tables[at[done]] = t[done]
            at, n, goal, a, p0, t = at[~done], n[~done], goal[~done], a[~done], p0[~done], t[~done]
    return tables


def sample(word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, totals: Totals, seed: int, burn: int = 2, samples: int = 2) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair tables, word customers, word tables) of each kept Gibbs sweep. Same input, same result."""
    rng, out = np.random.default_rng(seed), []
    base = np.full(n_words, 1.0 / (totals.known_words + 1))
    root_mass = totals.root_strength + totals.root_discount * totals.root_tables[0]
    # The first seating: every pair with one table.
    tables = (count > 0).astype(np.int64)
    served = np.bincount(word, tables, n_words).astype(np.int64)
    above = (served > 0).astype(np.int64)
    for sweep in range(burn + samples):
        # A pair sees its restaurant and the parent without its own tables.
        others = totals.strength + totals.discount * np.maximum(totals.tables[0][context] - tables, 0)
        free = root_mass * base[word]
        parent = np.maximum(served[word] - tables - totals.root_discount * above[word], 0) + free
        tables = seat(count, others, parent / (totals.root_strength + totals.root_customers[0] - tables), totals.discount, rng)
        served = np.bincount(word, tables, n_words).astype(np.int64)
        above = seat(served, totals.root_strength + totals.root_discount * np.maximum(totals.root_tables[0] - above, 0), base, totals.root_discount, rng)
        if sweep >= burn:
            out.append((tables, served, above))
    return out


def word_probability(served: np.ndarray, above: np.ndarray, totals: Totals, s: int) -> np.ndarray:
    mass = totals.root_strength + totals.root_discount * totals.root_tables[s]
    return (served - totals.root_discount * above + mass / (totals.known_words + 1)) / (totals.root_strength + totals.root_customers[s])


def _sums(word, context, count, n_words, drawn) -> tuple[np.ndarray, np.ndarray]:
    """Context sums (customers, tables of each sample) and scalar sums of one part."""
    by = [np.bincount(context, count, CONTEXTS), *[np.bincount(context, t, CONTEXTS) for t, _, _ in drawn]]
    per_word = np.bincount(word, count, n_words)
    scalars = [count.sum(dtype=np.int64), (per_word > 0).sum(), (count == 1).sum(), (count == 2).sum()]
    scalars += [(drawn[0][1] == 1).sum(), (drawn[0][1] == 2).sum()]
    scalars += [x for _, served, above in drawn for x in (served.sum(), above.sum())]
    return np.array(by, np.float64), np.array(scalars, np.float64)


def _start(word, context, count, n_words):
    """Before the first sweep: one table a pair."""
    one = (count > 0).astype(np.int64)
    served = np.bincount(word, one, n_words).astype(np.int64)
    return [(one, served, (served > 0).astype(np.int64))]


def _part_sums(totals: Totals | None, seed: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, scalars = None, None
        for batch in batches:
            for p, stats in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                word, context, count = _unpack(stats, np.uint32, np.uint16, np.uint32)
                n = int(word[-1]) + 1
                drawn = _start(word, context, count, n) if totals is None else sample(word, context, count, n, totals, seed + p)
                b, s = _sums(word, context, count, n, drawn)
                by, scalars = (b, s) if by is None else (by + b, scalars + s)
        if by is not None:
            blocks = CONTEXTS // _BLOCK
            cut = [np.ascontiguousarray(by[:, i * _BLOCK : (i + 1) * _BLOCK]).tobytes() for i in range(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(blocks), -1], pa.int32()), pa.array([*cut, scalars.tobytes()], pa.binary())], names=["block", "sums"])

    return of


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(b, np.float64)
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])


class Model:
    """Counts in partitions, the frequent words' counts here, and the totals of the samples."""

    def __init__(self, state: DataFrame, heavy: np.ndarray, seed: int = 1) -> None:
        self.state, self.heavy, self.seed = state, heavy, seed
        got = [_unpack(r.stats, *_COUNTS) for r in state.where("kind = 1").select("stats").toLocalIterator()]
        cat = lambda i, kind: np.concatenate([g[i] for g in got]).astype(kind) if got else np.zeros(0, kind)
        self.pairs = cat(0, np.int64), cat(1, np.int64), cat(2, np.int64)
        self.totals = self._sweep(None)
        self.totals = self._sweep(self.totals)  # these two settle the totals that sweeps see
        self.seen, self.totals = self.totals, self._sweep(self.totals)

    def _sweep(self, totals: Totals | None) -> Totals:
        parts = self.state.where("kind = 0").select("part", "stats").mapInArrow(_part_sums(totals, self.seed), "block int, sums binary")
        rows = parts.repartition(input_tasks(self.state.sparkSession), "block").mapInArrow(_add_sums, "block int, sums binary").collect()
        got = {r.block: np.frombuffer(r.sums, np.float64) for r in rows}
        word, context, count = self.pairs
        n = len(self.heavy)
        drawn = _start(word, context, count, n) if totals is None else sample(word, context, count, n, totals, self.seed - 1)
        by, scalars = _sums(word, context, count, n, drawn)
        if got:
            scalars = scalars + got.pop(-1)
            by = by + np.concatenate([got[i].reshape(len(by), _BLOCK) for i in range(CONTEXTS // _BLOCK)], axis=1)
        ones, twos, root_ones, root_twos = scalars[2:6]
        rate = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a + b else 0.5
        return Totals(by[0], by[1:], scalars[6::2], scalars[7::2], int(scalars[0]), int(scalars[1]), rate(ones, twos), rate(root_ones, root_twos))

    def pair_scores(self, word, context, count, n_words, seed) -> np.ndarray:
        return _pair_scores(word, context, count, n_words, self.seen, self.totals, seed)

    def heavy_table(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability by (frequent word, context), and each frequent word's training count."""
        word, context, count = self.pairs
        n = len(self.heavy)
        drawn = sample(word, context, count, n, self.seen, self.seed - 1)
        mean = np.zeros((n, CONTEXTS))
        for s, (tables, served, above) in enumerate(drawn):
            t = self.totals
            free = (t.strength + t.discount * t.tables[s]) / (t.strength + t.customers)
            one = free[None, :] * word_probability(served, above, t, s)[:, None]
            one[word, context] += (count - t.discount * tables) / (t.strength + t.customers[context])
            mean += one / len(drawn)
        return np.log10(mean).astype(np.float32), np.bincount(word, count, n)


def _pair_scores(word, context, count, n_words, seen: Totals, totals: Totals, seed: int) -> np.ndarray:
    drawn, mean = sample(word, context, count, n_words, seen, seed), np.zeros(len(word))
    whole = totals.strength + totals.customers[context]
    for s, (tables, served, above) in enumerate(drawn):
        parent = word_probability(served, above, totals, s)[word]
        free = totals.strength + totals.discount * totals.tables[s][context]
        mean += (count - totals.discount * tables + free * parent) / whole / len(drawn)
    return np.log10(mean)


def _base(count: np.ndarray, totals: Totals) -> np.ndarray:
    return np.log10((count + 0.5) / (totals.train_tokens + 0.5 * (totals.known_words + 1)))


SUMS = "row bigint, score double, base double, known bigint, tokens bigint, doc_id {id}, held_out boolean"
_ENTRIES = 2_000_000


def _entry_blobs(entries: list[tuple]) -> Iterator[tuple[int, bytes]]:
    """Sums by (piece, text): one blob for each piece."""
    names = np.concatenate([e[0] for e in entries])
    doc = np.concatenate([e[1] for e in entries]).astype(np.int64)
    pieces, at = np.unique(names, return_inverse=True)
    key, to = np.unique((at.astype(np.int64) << 32) | doc, return_inverse=True)
    score, base, known = (np.bincount(to, np.concatenate([e[i] for e in entries]), len(key)) for i in (2, 3, 4))
    cut = np.searchsorted(key, np.arange(len(pieces) + 1, dtype=np.int64) << 32)
    for i, name in enumerate(pieces.tolist()):
        s = slice(cut[i], cut[i + 1])
        text, known_here = _narrow(key[s] & 0xFFFFFFFF), _narrow(known[s])
        wide = np.array([text.itemsize == 4, known_here.itemsize == 4], np.int64)
        yield name, _pack(wide, text, score[s].astype(np.float32), base[s], known_here)


def _entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    wide = np.frombuffer(blob, np.int64, 2, 8 * 6)
    text, known = (np.uint32 if w else np.uint16 for w in wide)
    return tuple(_unpack(blob, np.int64, text, np.float32, np.float64, known)[1:])


def _score_parts(seen: Totals, totals: Totals, seed: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Light tokens' sums by piece, gathered over the parts that a task has, and the pieces' row keys (as kind 2)."""
        held, size = [], 0

        def rows(pieces: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array([kind] * len(pieces), pa.int32()), pa.array(blobs, pa.binary())], names=["piece", "kind", "blob"])

        for batch in batches:
            for p, kind, stats, posts in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if kind == 2:
                    n = int(np.frombuffer(posts, np.int64, 1)[0])
                    got = _unpack(posts, *[np.int64] * n)
                    yield rows([int(x[0]) for x in got[::2]], 2, [x.tobytes() for x in got[1::2]])
                    continue
                word, context, count = _unpack(stats, np.uint32, np.uint16, np.uint32)
                names, runs, piece, doc = _postings(posts)
                n = int(word[-1]) + 1
                score = np.repeat(_pair_scores(word, context, count, n, seen, totals, seed + p), runs)
                total = np.repeat(np.bincount(word, count, n)[word], runs)
                key, to = np.unique((piece.astype(np.int64) << 32) | doc, return_inverse=True)
                sums = [np.bincount(to, x, len(key)) for x in (score, _base(total, totals), total > 0)]
                held.append((names[key >> 32], key & 0xFFFFFFFF, *sums))
                size += len(key)
                if size >= _ENTRIES:
                    yield rows(*(lambda got: ([g[0] for g in got], 0, [g[1] for g in got]))(list(_entry_blobs(held))))
                    held, size = [], 0
        if held:
            yield rows(*(lambda got: ([g[0] for g in got], 0, [g[1] for g in got]))(list(_entry_blobs(held))))

    return of


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece: sums of each text of a piece, under its row key."""
    now, sums, keys = None, [], None

    def emit() -> pa.RecordBatch:
        got = [_entries(b) for b in sums]
        n = len(keys)
        doc = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.uint32)
        total = [np.bincount(doc, np.concatenate([g[i] for g in got]), n) if got else np.zeros(n) for i in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[0]), pa.array(total[1]), pa.array(total[2].astype(np.int64))], names=["row", "score", "base", "known"])

    for batch in batches:
        for piece, kind, blob in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if piece != now:
                if now is not None:
                    yield emit()
                now, sums, keys = piece, [], None
            if kind == 2:
                keys = np.frombuffer(blob, np.int64)
            else:
                sums.append(blob)
    if now is not None:
        yield emit()


def _score_heavy(heavy: np.ndarray, table, totals: Totals):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, count = table.value
        base = _base(count, totals)
        for batch in batches:
            done = []
            for (texts,) in _pieces(batch, ["text"]):
                h, context, doc = tokens(texts)
                at, there = _find(heavy, h)
                n = np.bincount(doc, minlength=len(texts))
                at, context, doc = at[there], context[there], doc[there]
                by = lambda x: np.bincount(doc, x, len(texts))  # noqa: E731, B023
                done.append((by(log[at, context]), by(base[at]), by(count[at] > 0), n))
            cols = [np.concatenate(c) for c in zip(*done)] if done else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int64)), pa.array(cols[3].astype(np.int64)), batch.column("doc_id"), batch.column("held_out")],
                names=["row", "score", "base", "known", "tokens", "doc_id", "held_out"],
            )

    return of


def learn(docs: DataFrame, seed: int = 1) -> Model:
    """docs(row bigint, text, learn boolean): all texts' tokens are laid out, counts are of rows to learn from."""
    heavy = frequent_words(docs)
    tasks = input_tasks(docs.sparkSession)
    parts = 4 * tasks  # a task holds one part at a time
    dealt = docs.select("text", "row", "learn").mapInArrow(_deal(heavy, parts), "part int, kind int, blob binary")
    state = dealt.repartition(tasks, "part").sortWithinPartitions("part", "kind").mapInArrow(_collate, "part int, kind int, stats binary, posts binary")
    model_state = written(state)
    del dealt, state
    release(docs.sparkSession)  # the shuffle is not needed any more
    return Model(model_state, heavy, seed)


def score(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs(doc_id, text, held_out) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the rows not held out."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"row": F.xxhash64("doc_id", "text"), "learn": ~F.col("held_out")}
    )
    model = learn(rows, seed)
    release(docs.sparkSession)  # of the sweeps, and of what was still in use right after the layout
    kind = SUMS.format(id=dict(docs.dtypes)["doc_id"])
    table = docs.sparkSession.sparkContext.broadcast(model.heavy_table())
    whole = rows.select("text", "row", "doc_id", "held_out").mapInArrow(_score_heavy(model.heavy, table, model.totals), kind)
    sums = model.state.where("kind <> 1").select("part", "kind", "stats", "posts").mapInArrow(_score_parts(model.seen, model.totals, model.seed), "piece bigint, kind int, blob binary")
    dealt = sums.repartition(input_tasks(docs.sparkSession), "piece").sortWithinPartitions("piece")
    parts = dealt.mapInArrow(_by_row, "row bigint, score double, base double, known bigint")
    every = whole.unionByName(parts, allowMissingColumns=True).groupBy("row").agg(
        F.sum("score").alias("score"), F.sum("base").alias("base"), F.sum("known").alias("known"), F.max("tokens").alias("tokens"),
        F.count("tokens").cast("int").alias("copies"), F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
    )
    return every.select(
        "doc_id",
        "held_out",
        F.col("tokens").alias("n_tokens"),
        (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(model.totals.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"),
    ).drop("copy")

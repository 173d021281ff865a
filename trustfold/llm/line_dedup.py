"""Line deduplication by a segment-partition edit join.

Lines are compared after lower-casing and joining their words by single blanks. Every line that is not blank counts: it is removed if
the same line occurs earlier, or a similar one. Lines are in order of the document id, then their place in it; the first of equal lines stands
for all of them. How similar depends on the shorter of two lines: from ``min_chars`` characters on they may differ by ``budget`` edits, from
``one_chars`` on by one, and still shorter ones (a word, a bracket, a number), of which an edit makes another line, by none.

For each of the two budgets, every distinct line of its lengths is cut into budget + 1 segments, and within the budget one segment of the shorter (or equal) line stands
unchanged in the other, at one of few places. So a line enters an index under (its length, segment number, segment), and
probes it with its own substrings at the places that the two lengths allow. Lines that meet are first held against
counts of letter pairs, which an edit changes by four at most, and then decided by a banded bit-parallel edit distance.

A small bucket gives its pairs. In a large one each line looks for one earlier witness, from the first line on, and asks no more
once it has one, so a group of n similar lines gives n rows; lines without a witness are held against all. Keys that are hot in
a sample are spread over tasks, and buckets of more than ``CELL`` lines are split into cells.

Defined cases: null and empty texts have no lines to remove and stay as they are; repeated rows (equal id and text) are treated alike, so a
line first seen in them stays in all of them; rows without an id come last in order; very long lines and texts are
compared whole. An empty table gives an empty result. Other columns pass through; of the columns that
:func:`dedup_lines` adds, ones with the same name are replaced. Lines are identified by 62-bit hashes, rows
by a 64-bit hash of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, input_tasks, release, text_slices, written

BUDGET = 2
#: Up to so many ids of lines in pairs (16 MB) are broadcast to fetch their texts; more of them are joined by a shuffle.
BROADCAST_LINES = 1_000_000
#: Of lines from this length on, two edits make no other line.
MIN_CHARS = 32
#: From this length on one edit makes no other line.
ONE_CHARS = 16
_U = np.uint64
_R = _U(0x5851F42D4C957F2D)
_R_INV = _U(pow(int(_R), -1, 1 << 64))
_CHUNK = 1 << 16
#: Buckets of more rows than this give no pairs, but members that look for one witness each.
_SMALL = 48
#: Buckets of more rows are not held, but pass through as members.
_LARGE = 1 << 16
#: Lines of a bucket that one task compares.
CELL = 4096
_CENTRES = 16
#: Tasks over which the entries of a hot key are spread.
_SPREAD = 4096


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 7) >> 2


def _lines(texts: list[str | None], min_chars: int) -> Iterator[tuple[int, int, str]]:
    """(text number, line number, normalised line) of the lines that count."""
    for n, text in enumerate(texts):
        if text:
            for k, line in enumerate(text.lower().split("\n")):
                if len(line) >= min_chars:
                    short = " ".join(line.split())
                    if len(short) >= min_chars:
                        yield n, k, short


def _occurrences(min_chars: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column("text")):
                found = [(at + n, k, line_id(t)) for n, k, t in _lines(texts.to_pylist(), min_chars)]
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(rows), batch.column("doc_id").take(rows), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64())],
                    names=["row", "doc_id", "line_no", "line"],
                )

    return of


def _distinct(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[list[str]]:
    for batch in batches:
        for _, texts in text_slices(batch.column("text")):
            yield list(dict.fromkeys(t for _, _, t in _lines(texts.to_pylist(), min_chars)))


def _texts(min_chars: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for once in _distinct(batches, min_chars):
            yield pa.RecordBatch.from_arrays([pa.array([line_id(t) for t in once], pa.int64()), pa.array(once, pa.string())], names=["line", "words"])

    return of


def segments(length: np.ndarray, number: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of one segment; the longer segments come last."""
    parts = budget + 1
    size, longer = length // parts, length % parts
    return number * size + np.maximum(0, number - (parts - longer)), size + (number >= parts - longer)


def _sketches(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Counts modulo 16 of hashed letter pairs, 16 of them in 64 bits."""
    pair = codes[:-1] * _U(31) + codes[1:]
    slot = (((pair * _U(0x9E3779B97F4A7C15)) >> _U(60)) << _U(2)).astype(_U)
    inside = np.ones(len(pair), bool)
    inside[(starts + sizes - 1)[(starts + sizes - 1) < len(pair)]] = False
    owner = np.repeat(np.arange(len(starts)), sizes)[: len(pair)]
    counts = np.bincount(owner[inside] * 16 + (slot[inside] >> _U(2)).astype(np.int64), minlength=16 * len(starts)).reshape(-1, 16) & 15
    return (counts.astype(_U) << (_U(4) * np.arange(16, dtype=_U))[None, :]).sum(axis=1, dtype=_U)


def sketch_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most four times the edits between the lines."""
    x, y = a.view(np.uint8).reshape(-1, 8), b.view(np.uint8).reshape(-1, 8)
    low, high = (x - y) & 15, ((x >> 4) - (y >> 4)) & 15
    return np.minimum(low, 16 - low).sum(axis=1, dtype=np.int64) + np.minimum(high, 16 - high).sum(axis=1, dtype=np.int64)


def keys(lines: list[str], budget: int, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line number, probe, sketch) of all index entries and probes of distinct lines."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    mixed = (codes + _U(1)) * _U(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> _U(29)
    up, down = np.full(len(codes), _R, _U), np.full(len(codes), _R_INV, _U)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mixed * up)])

    def hashed(at: np.ndarray, size: np.ndarray, length: np.ndarray, number: int) -> np.ndarray:
        h = (total[at + size] - total[at]) * down[np.minimum(at, len(codes) - 1)]
        h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185) + (length * (budget + 1) + number).astype(_U) * _U(0x9E3779B97F4A7C15)
        return (h ^ (h >> _U(29))).view(np.int64)

    key, line, probe = [], [], []
    every = np.arange(len(lines))
    for i in range(budget + 1):
        at, size = segments(sizes, i, budget)
        key.append(hashed(starts + at, size, sizes, i))
        line.append(every)
        probe.append(np.zeros(len(lines), bool))
    for shorter in range(budget + 1):
        length = sizes - shorter
        for i in range(budget + 1):
            at, size = segments(length, i, budget)
            first = np.maximum(np.maximum(at - i, at + shorter - (budget - i)), 0)
            last = np.minimum(np.minimum(at + i, at + shorter + (budget - i)), sizes - size)
            for step in range(2 * budget + 1):
                fits = np.flatnonzero((length >= min_chars) & (first + step <= last))
                if len(fits):
                    key.append(hashed(starts[fits] + first[fits] + step, size[fits], length[fits], i))
                    line.append(fits)
                    probe.append(np.ones(len(fits), bool))
    line = np.concatenate(line)
    return np.concatenate(key), line, np.concatenate(probe), _sketches(codes, starts, sizes)[line]


ENTRIES = "key bigint, mark bigint, sketch bigint"


def tiers(budget: int, min_chars: int, one_chars: int) -> list[tuple[int, int, int]]:
    """(least, greatest) length of the shorter of two lines and the edits by which they may differ; lines too short for their segments are left out."""
    full = max(min_chars, 2 * budget + 2)
    out = [(full, 1 << 62, budget)]
    if budget > 1 and max(one_chars, 4) < full:
        out.append((max(one_chars, 4), full - 1, 1))
    return out


def _entries(budgets: list[tuple[int, int, int]], hot: np.ndarray | None = None):
    hot = np.zeros(0, np.int64) if hot is None else hot

    def tiered(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for least, most, budget in budgets:
            own = [i for i, t in enumerate(lines) if least <= len(t) <= most + budget]
            if own:
                key, line, probe, sketch = keys([lines[i] for i in own], budget, least)
                parts.append((key, np.array(own)[line], probe, sketch))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for once in _distinct(batches, min(least for least, _, _ in budgets)):
            at = 0
            while at < len(once):
                end, size = at, 0
                while end < len(once) and (end == at or size + len(once[end]) <= _CHUNK):
                    size += len(once[end])
                    end += 1
                ids = np.array([line_id(t) for t in once[at:end]], np.int64)
                key, line, probe, sketch = tiered(once[at:end])
                columns = {"key": key, "mark": ids[line] * 2 + probe, "sketch": sketch.view(np.int64)}
                if len(hot):
                    salt = np.zeros(len(key), np.int16)
                    at_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                    salt[at_hot] = 1 + (ids[line[at_hot]] >> 7) % _SPREAD
                    columns["salt"] = salt
                yield pa.RecordBatch.from_pydict(columns)
                at = end

    return of


def _sizes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the runs of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.concatenate([start, [len(new)]]))


def partnered(some: np.ndarray, others: np.ndarray, budget: int) -> np.ndarray:
    """Which of some sketches are near enough to any of the others; what has found one asks no more."""
    found, open_, at, width = np.zeros(len(some), bool), np.arange(len(some)), 0, 16
    while len(open_) and at < len(others):
        part = others[at : at + width]
        for i in range(0, len(open_), 1 << 14):
            ask = open_[i : i + (1 << 14)]
            near = sketch_gap(np.repeat(some[ask], len(part)), np.tile(part, len(ask))) <= 4 * budget
            found[ask[near.reshape(len(ask), -1).any(axis=1)]] = True
        open_, at, width = open_[~found[open_]], at + width, min(2 * width, 64)
    return found


def bucket_pairs(key: np.ndarray, mark: np.ndarray, sketch: np.ndarray, budget: int, most: int = _SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Of whole buckets (rows sorted by key): pairs of an index entry and a probe whose sketches allow the budget, and of
    buckets with more than ``most`` rows, instead of pairs, the rows that have such a partner."""
    start, size = _sizes(key)
    line, probe = mark >> 1, (mark & 1).astype(bool)
    probes = np.add.reduceat(probe, start, dtype=np.int64)
    useful = (probes > 0) & (probes < size)
    pairs, members = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
    for s, n in zip(start[useful & (size > most)].tolist(), size[useful & (size > most)].tolist()):
        # Repeats of a line come from different pieces of the input.
        _, once = np.unique(mark[s : s + n], return_index=True)
        once += s
        left, right = once[~probe[once]], once[probe[once]]
        left = left[partnered(sketch[left], sketch[right], budget)]
        members += [left, right[partnered(sketch[right], sketch[left], budget)]]
    at = np.flatnonzero(np.repeat(useful & (size <= most), size))
    run = np.repeat(np.arange(len(size)), size)[at]
    for step in range(1, min(most, len(at))):
        same = np.flatnonzero(run[step:] == run[:-step])
        if not len(same):
            break
        i, j = at[same], at[same + step]
        near = (line[i] != line[j]) & (probe[i] != probe[j])
        i, j = i[near], j[near]
        near = sketch_gap(sketch[i], sketch[j]) <= 4 * budget
        pairs.append(np.stack([np.minimum(line[i], line[j])[near], np.maximum(line[i], line[j])[near]], axis=1))
    return np.unique(np.concatenate(pairs), axis=0), np.concatenate(members)


def _meet(budget: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key (and salt, where some key is hot) to pairs (a, b, null) and members (line, null, key) of large buckets.

        The last bucket of a batch waits for the next. Once it passes ``_LARGE`` rows its rows are members as they come, like
        those of a hot key (salt > 0).
        """
        held: list[list[np.ndarray]] = []
        wide = None

        def rows(pairs: np.ndarray, key: np.ndarray, line: np.ndarray) -> Iterator[pa.RecordBatch]:
            lone = np.unique(np.stack([key, line], axis=1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
            if len(pairs) + len(lone):
                no = np.concatenate([np.zeros(len(pairs), bool), np.ones(len(lone), bool)])
                a = np.concatenate([pairs[:, 0], lone[:, 1]])
                b = np.concatenate([pairs[:, 1], lone[:, 0]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=no), pa.array(b, mask=~no)], names=["a", "b", "key"])

        def settle(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(part[0]):
                pairs, at = bucket_pairs(part[0], part[1], part[2].view(_U), budget)
                yield from rows(pairs, part[0][at], part[1][at] >> 1)

        for batch in batches:
            key, mark, sketch = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            through = batch.column(3).to_numpy(zero_copy_only=False) > 0 if batch.num_columns > 3 else np.zeros(len(key), bool)
            if wide is not None:
                through = through | (key == wide)
            if through.any():
                yield from rows(np.zeros((0, 2), np.int64), key[through], mark[through] >> 1)
                key, mark, sketch = key[~through], mark[~through], sketch[~through]
            if not len(key):
                continue
            held.append([key, mark, sketch])
            if key[0] == key[-1] == held[0][0][-1]:
                if sum(len(h[0]) for h in held) <= _LARGE:
                    continue
            whole = [np.concatenate([h[i] for h in held]) for i in range(3)]
            other = np.flatnonzero(whole[0] != whole[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            yield from settle([h[:cut] for h in whole])
            rest = [h[cut:] for h in whole]
            held = [rest]
            if len(rest[0]) > _LARGE:
                _, once = np.unique(rest[1], return_index=True)
                held = [[h[once] for h in rest]]
                if len(once) > _LARGE // 2:
                    wide, held = rest[0][-1], []
                    yield from rows(np.zeros((0, 2), np.int64), rest[0], rest[1] >> 1)
        if held:
            yield from settle([np.concatenate([h[i] for h in held]) for i in range(3)])

    return of


def within(left: list[str], right: list[str], budget: int) -> np.ndarray:
    """Whether each two lines differ by ``budget`` edits at most.

    Bit-parallel columns of the band of 2 * budget + 1 diagonals, for all pairs at once. The score is
    followed down the band's lower edge to the last row, and then along that row.
    """
    if not 0 < budget < 31:
        raise ValueError("the band must fit a word")
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    ok = np.flatnonzero((np.abs(m - n) <= budget) & (m > budget))
    out = np.zeros(len(left), bool)
    for i in np.flatnonzero((m <= budget) & (np.abs(m - n) <= budget)).tolist():
        out[i] = _plain(left[i], right[i]) <= budget
    ok = ok[np.argsort(n[ok], kind="stable")]
    for part in np.array_split(ok, max(1, -(-len(ok) // 2048))):
        if not len(part):
            continue
        rows, columns = m[part], n[part]
        width, wide = int(columns.max()), int(max(rows.max(), columns.max())) + 2 * budget + 1
        a, b = np.full((len(part), wide), -1, np.int32), np.full((len(part), width), -2, np.int32)
        for r, i in enumerate(part.tolist()):
            a[r, budget : budget + m[i]] = np.frombuffer(left[i].encode("utf-32-le", "surrogatepass"), np.int32)
            b[r, : n[i]] = np.frombuffer(right[i].encode("utf-32-le", "surrogatepass"), np.int32)
        one, top = _U(1), _U(63)
        vp, vn = np.full(len(part), (0xFFFFFFFFFFFFFFFF << (63 - budget)) & 0xFFFFFFFFFFFFFFFF, _U), np.zeros(len(part), _U)
        score, alive = np.full(len(part), budget, np.int64), np.arange(len(part))
        for c in range(width):
            x = np.zeros(len(part), _U)
            for t in range(2 * budget + 1):  # pattern row c - budget + t
                x |= (a[:, c + t] == b[:, c]).astype(_U) << _U(63 - 2 * budget + t)
            d = (((x & vp) + vp) ^ vp) | x | vn
            hp, hn = vn | ~(d | vp), d & vp
            down = c < rows - budget
            score += down & ((d >> top) == 0)
            bit = np.clip(62 - (c - (rows - budget)), 0, 62).astype(_U)
            along = ~down & (c < columns)
            score += along & ((hp >> bit) & one).astype(bool)
            score -= along & ((hn >> bit) & one).astype(bool)
            vp, vn = hn | ~((d >> one) | hp), (d >> one) & hp
            if c % 32 == 31:  # on the edge the score never falls, and beyond it by 2 * budget at most
                live = score <= 3 * budget
                if live.sum() < 0.7 * len(live):
                    rows, columns, a, b, vp, vn, score, alive = (v[live] for v in (rows, columns, a, b, vp, vn, score, alive))
                    part = part[live]
                    if not len(part):
                        break
        out[part] = score <= budget
    return out


def alike(left: list[str], right: list[str], budget: int, full_chars: int = 0) -> np.ndarray:
    """:func:`within`, but by one edit only where the shorter line is below ``full_chars``."""
    near = within(left, right, budget)
    short = [i for i in np.flatnonzero(near).tolist() if min(len(left[i]), len(right[i])) < full_chars]
    if short and budget > 1:
        near[short] = within([left[i] for i in short], [right[i] for i in short], 1)
    return near


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _verify(budget: int, full_chars: int = 0):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = alike(batch.column("left").to_pylist(), batch.column("right").to_pylist(), budget, full_chars)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return of


def _text_sketches(words: list[str]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    return _sketches(codes, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


def witnessed(words: list[str], start: np.ndarray, size: np.ndarray, asks: np.ndarray, budget: int, full_chars: int = 0) -> np.ndarray:
    """Of lines in order, in buckets (start, size), which of those that ask are within the budget of some line before them in their bucket.

    Lines are held against the first ones first, and one that has found a witness asks no more; all others are held against every line
    before them. Pairs of all buckets are verified together.
    """
    sketch, found = _text_sketches(words), np.zeros(len(words), bool)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        x, y = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
        waiting.clear()
        new = ~found[x]
        x, y = x[new], y[new]
        ok = alike([words[k] for k in y.tolist()], [words[k] for k in x.tolist()], budget, full_chars)
        found[x[ok]] = True

    open_ = [(s, n, s + np.flatnonzero(asks[s : s + n])) for s, n in zip(start.tolist(), size.tolist())]
    at, width = 0, 1
    while open_:
        for s, n, lines in open_:
            before = np.arange(s + at, min(s + n, s + at + width))
            for i in range(0, len(lines), 1 << 13):
                ask = lines[i : i + (1 << 13)]
                x, y = np.repeat(ask, len(before)), np.tile(before, len(ask))
                near = y < x
                x, y = x[near], y[near]
                near = sketch_gap(sketch[x], sketch[y]) <= 4 * budget
                waiting.append((x[near], y[near]))
                if sum(len(w[0]) for w in waiting) >= 1 << 15:
                    settle()
        if waiting:
            settle()
        at, width = at + width, min(2 * width, 32)
        open_ = [(s, n, left) for s, n, lines in open_ if at < n and len(left := lines[~found[lines] & (lines > s + at)])]
    return found


def _witnesses(budget: int, full_chars: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, cell, line, words, asks) sorted by key, cell and place to the lines that have a witness; holds the open cell."""
        held: list[pa.Table] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, cell, line, asks = (table.column(n).to_numpy() for n in ("key", "cell", "line", "asks"))
            # A line may stand in a cell twice, as one that asks and as a witness; its rows are neighbours.
            first, _ = _sizes(key, cell, line)
            start, size = _sizes(key[first], cell[first])
            asks = np.logical_or.reduceat(asks.astype(bool), first)
            near = witnessed(table.column("words").take(pa.array(first)).to_pylist(), start, size, asks, budget, full_chars)
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(line[first[near]]))], names=["line"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            last = [batch.column(n)[batch.num_rows - 1] for n in ("key", "cell")]
            if last == [held[0].column(n)[-1] for n in ("key", "cell")]:
                continue
            table = pa.concat_tables(held).combine_chunks()
            start, _ = _sizes(*(table.column(n).to_numpy() for n in ("key", "cell")))
            yield from done(table.slice(0, int(start[-1])))
            held = [table.slice(int(start[-1]))]
        if held:
            yield from done(pa.concat_tables(held).combine_chunks())

    return of


def _near_centre(budget: int, full_chars: int):
    def of(words: pa.Array, centres: pa.Array) -> pa.Array:
        """Whether each line is within the budget of any of its centres."""
        size, own = centres.value_lengths().to_pylist(), words.to_pylist()
        left, right = centres.flatten().to_pylist(), [w for w, n in zip(own, size) for _ in range(n)]
        owner = np.repeat(np.arange(len(own)), size)
        near = np.zeros(len(own), bool)
        if left:
            near[owner[alike(left, right, budget, full_chars)]] = True
        return pa.array(near)

    return of


def bucket_witnesses(members: DataFrame, known: DataFrame, budget: int, most: int = CELL, full_chars: int = 0) -> DataFrame:
    """members(key, line) of large buckets and known(line, words, place) to the lines (once or more) that are within the budget of an
    earlier line of a bucket.

    Buckets of more than ``most`` lines are split: lines near one of a few early lines of the bucket are settled first, one by one.
    Those left ask in every part of their bucket, in parts of their own, so that no task holds more than a cell.
    """
    rows = members.join(known, "line")
    sizes = written(members.groupBy("key").agg(F.count("*").alias("n")))
    tasks = input_tasks(members.sparkSession)
    none = F.lit(0).cast("long")

    def judged(cells: DataFrame) -> DataFrame:
        dealt = cells.repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell", "place", "line")
        return dealt.select("key", "cell", "line", "words", "asks").mapInArrow(_witnesses(budget, full_chars), "line bigint")

    hot = sizes.where(F.col("n") > most).withColumn("parts", F.ceil(F.col("n") * 2 / most).cast("long"))
    if hot.isEmpty():
        return judged(rows.select("*", none.alias("cell"), F.lit(True).alias("asks")))
    cold = judged(rows.join(sizes.where(F.col("n") <= most), "key").select("key", "line", "words", "place", none.alias("cell"), F.lit(True).alias("asks")))
    large = rows.join(hot, "key").withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")))
    early = large.groupBy("key", "part").agg(F.min(F.struct("place", "words")).alias("c"))
    early = early.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("c.place"))).where(F.col("nth") <= _CENTRES)
    early = early.groupBy("key").agg(F.collect_list("c").alias("centres"))
    before = F.transform(F.filter("centres", lambda c: c["place"] < F.col("place")), lambda c: c["words"])
    settled = written(large.join(early, "key").select("key", "line", F.arrow_udf(_near_centre(budget, full_chars), "boolean")("words", before).alias("near")))
    left = settled.where("not near").select("key", "line")
    asking = written(left.groupBy("key").agg(F.ceil(F.count("*") * 2 / most).cast("long").alias("ask_parts")))
    cell = lambda part, other: F.col(part) * F.col("ask_parts") + F.col(other)
    large = large.join(asking, "key")
    ask_part = F.pmod(F.xxhash64("line", F.lit(1)), F.col("ask_parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stand = large.withColumn("other", every("ask_parts")).select("key", "line", "words", "place", cell("part", "other").alias("cell"), F.lit(False).alias("asks"))
    ask = large.join(left, ["key", "line"], "left_semi").withColumn("other", ask_part).withColumn("at", every("parts"))
    ask = ask.select("key", "line", "words", "place", cell("at", "other").alias("cell"), F.lit(True).alias("asks"))
    return cold.unionByName(settled.where("near").select("line")).unionByName(judged(stand.unionByName(ask)))


def hot_keys(docs: DataFrame, budgets: list[tuple[int, int, int]], one_in: int = 64, share: float = 1e-5) -> np.ndarray:
    """Keys that hold more than ``share`` of the entries of a hashed sample of the rows, so 1 / share at most, sorted.

    They only route: entries under them are spread over tasks, and their buckets are split.
    """
    some = docs.where(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0).select("text")
    count = written(some.mapInArrow(_entries(budgets), ENTRIES).groupBy("key").count())
    total = count.agg(F.sum("count")).first()[0] or 0
    found = count.where(F.col("count") > F.greatest(F.lit(512), F.lit(total * share))).select("key").toArrow().column(0).to_numpy()
    return np.sort(found)


def similar_later(docs: DataFrame, first: DataFrame, budget: int = BUDGET, min_chars: int = MIN_CHARS, one_chars: int = ONE_CHARS, most: int = CELL) -> DataFrame:
    """docs(row, text) and first(line, first), the first place of each line, to the ids of the lines (once or more) that are
    within the budget of a line with an earlier first place."""
    spark = docs.sparkSession
    budgets = tiers(budget, min_chars, one_chars)
    full, least = budgets[0][0], budgets[-1][0]
    hot = hot_keys(docs, budgets)
    by = ["key", "salt"] if len(hot) else ["key"]
    entries = docs.select("text").mapInArrow(_entries(budgets, hot), ENTRIES + (", salt smallint" if len(hot) else ""))
    dealt = entries.repartition(input_tasks(spark), *by).sortWithinPartitions(*by)
    met = written(dealt.mapInArrow(_meet(budget), "a bigint, b bigint, key bigint"))
    del entries, dealt
    release(spark)  # the entries' shuffle is not needed any more
    pairs, members = written(met.where("key is null").select("a", "b").distinct()), written(met.where("key is not null").select("key", F.col("a").alias("line")).distinct())
    ends = written(pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(members.select("line")).distinct())
    if small := ends.count() <= BROADCAST_LINES:
        ends = F.broadcast(ends)
    wanted = written(first.join(ends, "line", "left_semi").select("line", F.col("first").alias("place")))
    where = written(wanted.select(F.col("place.row").alias("row")).distinct())
    holders = docs.join(F.broadcast(where) if small else where, "row", "left_semi")
    texts = holders.select("text").mapInArrow(_texts(least), "line bigint, words string").join(ends, "line", "left_semi")
    known = written(texts.groupBy("line").agg(F.max("words").alias("words")).join(wanted, "line"))
    side = lambda end, words: known.select(F.col("line").alias(end), F.col("words").alias(words), F.col("place").alias(f"first_{end}"))
    asked = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")
    # The later line of each pair comes second.
    back = F.col("first_b") < F.col("first_a")
    asked = asked.select(F.when(back, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("b"), "left", "right")
    later = asked.mapInArrow(_verify(budget, full), "a bigint, b bigint").select(F.col("b").alias("line"))
    if members.isEmpty():
        return later
    return later.unionByName(bucket_witnesses(members, known, budget, most, full))


def removals(docs: DataFrame, budget: int = BUDGET, min_chars: int = MIN_CHARS, one_chars: int = ONE_CHARS) -> DataFrame:
    """docs(row, doc_id, text) to (row, removed array<int>): the numbers (from 0) of the lines to remove."""
    kind = dict(docs.dtypes)["doc_id"]
    seen = written(docs.select("row", "doc_id", "text").mapInArrow(_occurrences(1), f"row bigint, doc_id {kind}, line_no int, line bigint"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "row")
    first = written(seen.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    later = written(similar_later(docs, first, budget, min_chars, one_chars).distinct())
    judged = first.join(later.withColumn("similar", F.lit(True)), "line", "left").where("n > 1 or similar").select("line", "first", F.coalesce("similar", F.lit(False)).alias("similar"))
    judged = written(judged)
    release(docs.sparkSession)  # all that is still to be read is in tables
    gone = seen.join(judged, "line").where(F.col("similar") | ~place.eqNullSafe(F.col("first")))
    return gone.groupBy("row").agg(F.collect_set("line_no").alias("removed"))


def _without(text: pa.Array, removed: pa.Array) -> pa.Array:
    out = []
    for t, gone in zip(text.to_pylist(), removed.to_pylist()):
        if t is not None and gone:
            gone = set(gone)
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out.append(t)
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, budget: int = BUDGET, min_chars: int = MIN_CHARS, one_chars: int = ONE_CHARS) -> DataFrame:
    """``docs`` with text without its repeated lines, and n_lines and n_removed added."""
    bound_batches(docs.sparkSession)
    key = F.xxhash64("doc_id", "text")
    gone = removals(docs.select(key.alias("row"), "doc_id", "text"), budget, min_chars, one_chars)
    joined = docs.select(F.struct("*").alias("doc"), key.alias("row")).join(gone, "row", "left")
    text = F.col("doc.text")
    new = {
        "text": F.when(F.col("removed").isNull(), text).otherwise(F.arrow_udf(_without, "string")(text, F.col("removed"))),
        "n_lines": F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0),
        "n_removed": F.coalesce(F.size("removed"), F.lit(0)),
    }
    names = docs.columns + [c for c in ("n_lines", "n_removed") if c not in docs.columns]
    return joined.select(*[(new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in names])

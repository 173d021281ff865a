import random
from collections import Counter

import numpy as np
import pytest

from trustfold.llm import suffix_dedup as sd


def brute(texts, length):
    """Covered bytes by text, for any other start and for earlier starts only."""
    places = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            places.setdefault(t[i : i + length], []).append((d, i))
    every, later = [bytearray(len(t)) for t in texts], [bytearray(len(t)) for t in texts]
    for at in places.values():
        if len(at) > 1:
            for n, (d, i) in enumerate(sorted(at)):
                every[d][i : i + length] = b"\1" * length
                if n:
                    later[d][i : i + length] = b"\1" * length
    return every, later


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30) for _ in range(4)]
    out = ["", "short", "The " * 300, "ab" * 90, "ab" * 89 + "c"]
    for _ in range(60):
        t = prose(rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 2)
            t += " " + s[a : rng.randrange(a + 1, len(s) + 1)] + " " + prose(rng.randrange(0, 10))
        out.append(t)
    return [*out, out[9], out[10], out[10]]


@pytest.mark.parametrize("most_segments", [4096, 3])
def test_matches_brute_force(spark, most_segments):
    texts = corpus(random.Random(6))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every, later = brute([t.encode() for t in texts], 40)
    for earliest, want in ((False, every), (True, later)):
        got = {r.doc_id: r for r in sd.remove_repeats(df, 40, earliest, most_segments=most_segments).collect()}
        for d, t in enumerate(texts):
            raw, gone = t.encode(), want[d]
            assert bytes(got[d].kept) == bytes(b for b, g in zip(raw, gone) if not g), (d, earliest)
            assert got[d].n_removed == sum(gone) and got[d].n_bytes == len(raw)
            assert len(got[d].spans) == sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))


def test_longest_factors_match_brute_force():
    rng = np.random.default_rng(3)
    for cap in (5, 8, 21, 40):
        data = rng.integers(97, 99, 300).astype(np.uint8)
        data[150:220] = data[20:90]
        starts = np.sort(rng.choice(300 - cap, 120, replace=False))
        raw = data.tobytes()
        lcp = lambda i, j: next((k for k in range(cap) if raw[i + k] != raw[j + k]), cap)  # noqa: E731, B023
        previous, following = sd.longest_factors(data, starts, cap)
        for n, i in enumerate(starts.tolist()):
            assert previous[n] == max([lcp(i, j) for j in starts[:n].tolist()], default=0)
            assert following[n] == max([lcp(i, j) for j in starts[n + 1 :].tolist()], default=0)


def test_sliding_least():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 7, 200):
        assert sd.sliding_least(x, w).tolist() == [x[i : i + w].min() for i in range(200 - w + 1)]


def test_edge_cases(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(30_000))
    rows = [(1, None, 5), (2, "", 5), (None, long, 5), (3, long, 5), (4, long[100:600], 5), (4, long[100:600], 5), (5, "é" * 300, 5)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, row int"))
    by = Counter((str(r.doc_id), r.n_bytes, r.n_removed) for r in got.collect())
    assert by == Counter([("1", 0, 0), ("2", 0, 0), ("None", 30_000, 30_000), ("3", 30_000, 30_000), ("4", 500, 500), ("4", 500, 500), ("5", 600, 600)])
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trustfold.llm import divergence


def brute(rows, least, top):
    docs = [(lang or "", source or "", [normal(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in df.keys() | {k for k, _ in groups}:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        here = {s: [c[t] for t in kept] for (k, s), c in groups.items() if k == lang}
        v = len(kept)
        share = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * v) for x in c]  # noqa: E731, B023
        q = share([sum(x) for x in zip(*here.values())]) if v else []
        for s, c in here.items():
            p = share(c)
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p, share(o))), k.encode(), k) for k, o in here.items() if k != s))
            out += [(lang, s, "pair", k, -f, n + 1) for n, (f, _, k) in enumerate(pairs)]
            marks = sorted((b - a, t.encode(), t) for t, x, a, b in zip(kept, c, p, q) if x and a > b)
            out += [(lang, s, "term", t, -f, n + 1) for n, (f, _, t) in enumerate(marks[:top])]
    return sorted(out)


def normal(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def made(seed, n=150):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "of", "naïve", "über", "ÜBER", "x1y", "a-b", "日本", *("w" + chr(97 + k) for k in range(20)), *("v" + chr(97 + k) for k in range(20))]
    weight = 1 / np.arange(1, len(words) + 1)
    rows = []
    for k in range(n):
        source = f"s{rng.integers(5)}"
        w = np.roll(weight, int(rng.integers(3)) * (source > "s2"))
        rows.append((" ".join(rng.choice(words, rng.integers(0, 60), p=w / w.sum())), str(rng.choice(["en", "de"])), source))
    return rows + [(None, "en", "s0"), ("", None, None), ("only here " * 5, "fr", "s1"), ("123 !", "fr", "s2"), ("the of", "en", "empty"), ("zzz", "en", "none")] + rows[:20]


@pytest.mark.parametrize("least, top", [(30, 50), (5, 3), (1, 1), (1000, 50)])
def test_matches_brute_force(spark, least, top):
    rows = made(least)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert sorted(tuple(r) for r in divergence.audit(df, least, top).collect()) == brute(rows, least, top)


def test_small_dictionaries_and_slow_rounds_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    monkeypatch.setattr(divergence, "ROUND_GROWTH", 2)
    rows = made(9, 100)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(df, 2, 2).collect()) == brute(rows, 2, 2)


def test_ties_long_texts_other_columns_and_empty_tables(spark):
    rows = [("Éa " + "b c d " * 50_000, "x", "s"), ("b c d", "x", "t")] + [("b e", "x", "t")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "text string, lang string, source string, term int, p string")
    assert sorted(tuple(r) for r in divergence.audit(df, 1, 2).collect()) == brute(rows, 1, 2)
    assert divergence.audit(df.where("false")).count() == 0


def test_counts_beyond_63_bits_stay_exact(spark):
    big = 3 * 10**11
    df = spark.range(1).select(divergence._share(divergence.F.lit(big), divergence.F.lit(10 * big), divergence.F.lit(7).cast("bigint")).alias("p"))
    assert df.first().p == 1 + 10**9 * (big + 5) // (10 * big + 35)

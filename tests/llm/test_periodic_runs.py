import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from trustfold.llm import periodic_runs, queries

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(ws, least=12):
    """All runs, by trying every period: maximal stretches of equal words p apart, the smallest period of each."""
    found = {}
    for p in range(1, len(ws) // 2 + 1):
        equal = np.array([ws[i] == ws[i + p] for i in range(len(ws) - p)] + [False])
        at = 0
        while at < len(equal):
            end = at
            while equal[end]:
                end += 1
            if end - at >= p and end - at + p >= least:
                found.setdefault((at, end - at + p), p)
            at = end + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_kept(ws, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def judged(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in periodic_runs.find_runs(df, **how).orderBy("doc_id").collect()]


def test_matches_brute_force_on_random_words(spark):
    rng = np.random.default_rng(3)
    texts = []
    for k in range(120):
        ws = [str(v) for v in rng.integers(0, rng.integers(1, 5), rng.integers(0, 80))]
        if k % 3 == 0:
            ws += [str(v) for v in rng.integers(0, 9, 7)] * int(rng.integers(2, 5)) + ["x"]
        texts.append(" ".join(ws))
    for least in (12, 4):
        for text, r in zip(texts, judged(spark, texts, least=least)):
            want = brute(words_of(text), least)
            assert [tuple(x) for x in r.runs] == want
            assert r.collapsed == brute_kept(words_of(text), want)


def test_small_slabs_and_shared_arrays_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(0, 3, 60))) for _ in range(40)]
    want = [list(periodic_runs._judge([t.encode()], 12)) for t in texts]
    monkeypatch.setattr(periodic_runs, "SLAB", 7)
    assert list(periodic_runs._judge([t.encode() for t in texts], 12)) == [w[0] for w in want]


def test_defined_cases(spark):
    texts = [None, "", " \t\r\n\x0b\x0c ", "a b " * 6, "a b " * 6, "é ü " * 12, "w", "a " * 11, "x " + "a " * 12 + "y", "lang " * 200_000]
    got = judged(spark, texts)
    runs = [[tuple(x) for x in r.runs] for r in got]
    assert runs[:3] == [[], [], []] and [r.collapsed for r in got[:3]] == ["", "", ""]
    assert runs[3] == runs[4] == [(0, 12, 2)] and got[3].collapsed == "a b"
    assert runs[5] == [(0, 12, 1)]  # spaces that are not ASCII belong to words
    assert runs[6:8] == [[], []] and got[7].collapsed == " ".join("a" * 11)
    assert runs[8] == [(1, 12, 1)] and got[8].collapsed == "x a y"
    assert runs[9] == [(0, 200_000, 1)] and got[9].collapsed == "lang"


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 12, 5, 6, "t")], "doc_id long, text string, said int, doc int, runs string")
    got = periodic_runs.find_runs(df)
    assert got.columns == ["doc_id", "text", "said", "doc", "runs", "collapsed"]
    (r,) = got.collect()
    assert (r.said, r.doc, r.collapsed, [tuple(x) for x in r.runs]) == (5, 6, "a", [(0, 12, 1)])
    assert periodic_runs.find_runs(df.where("false")).count() == 0
    assert periodic_runs.find_runs(df.select(F.col("text").alias("t")), F.col("t")).columns == ["t", "runs", "collapsed"]


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    assert got.keys() == docs.keys()
    planted = 0
    for i, text in docs.items():
        ws, h = words_of(text), zlib.crc32(str(i).encode())
        n, g = len(ws), h // 10
        if len(ws) > 3000 and h % 10:  # the plain way takes the square of the words
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
        runs = brute(ws)
        planted += bool(runs)
        r = got[i]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_kept(ws, runs).encode()).hexdigest()
    assert planted >= 10

import random

import numpy as np

from trustfold.llm import line_dedup as ld


def edits(rng, line, n):
    t = list(line)
    for _ in range(n):
        at, how = rng.randrange(max(1, len(t))), rng.randrange(3) if t else 2
        if how == 0:
            t[at] = rng.choice("abcé")
        elif how == 1:
            del t[at]
        else:
            t.insert(at, rng.choice("abcé"))
    return "".join(t)


def lines(rng, n):
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(10, 40))) for _ in range(n)]
    return base + [edits(rng, rng.choice(base), rng.randrange(5)) for _ in range(3 * n)]


def test_banded_distance_matches_plain():
    rng = random.Random(2)
    for budget in (1, 2, 5):
        left = lines(rng, 60) + ["", "a", "ab"]
        right = [edits(rng, t, rng.randrange(2 * budget + 1)) if t else "b" for t in left]
        got = ld.within(left, right, budget)
        want = [ld._plain(a, b) <= budget for a, b in zip(left, right)]
        assert got.tolist() == want and any(want) and not all(want)
    long = "".join(rng.choice("ab") for _ in range(30_000))
    assert ld.within([long, long], [long[:-1] + "cc", "ccc" + long], 2).tolist() == [True, False]


def brute(docs, budget, full=ld.MIN_CHARS, one=ld.ONE_CHARS):
    """Line numbers to remove of each document: every line against every one before it."""
    order = sorted((i is None, i, k, d) for d, (i, t) in enumerate(docs) for k, _ in enumerate((t or "").split("\n")))
    allowed = lambda n: budget if n >= max(full, 2 * budget + 2) else min(budget, 1) if n >= one else 0
    seen, gone = [], {}
    for _, _, k, d in order:
        t = ld.normal(docs[d][1].split("\n")[k]) if docs[d][1] else ""
        if not t:
            continue
        if t in seen or any(ld._plain(t, s) <= allowed(min(len(t), len(s))) for s in seen if abs(len(s) - len(t)) <= budget):
            gone.setdefault(d, set()).add(k)
        if t not in seen:
            seen.append(t)
    return gone


def test_documents_match_brute_force(spark):
    rng = random.Random(5)
    for budget in (1, 2):
        pool = lines(rng, 25)
        docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7)))) for i in range(40)] + [(100, None), (101, "")]
        want = brute(docs, budget, 12, 12)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "text")
        got = {r.doc_id: r for r in ld.dedup_lines(df, budget, 12, 12).collect()}
        for d, (i, t) in enumerate(docs):
            keep = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(d, ()))
            assert got[i].text == keep and got[i].n_removed == len(want.get(d, ()))


def similar_pool(rng, n):
    head, tail = "same start of every line ", " and the same end of it all"
    return list(dict.fromkeys(edits(rng, head, rng.randrange(3)) + edits(rng, "middle part", rng.randrange(3)) + tail for _ in range(n)))


def test_large_buckets_lose_nothing():
    rng = random.Random(8)
    pool = similar_pool(rng, 150)
    want = {(i, j) for i in range(len(pool)) for j in range(i + 1, len(pool)) if ld._plain(pool[i], pool[j]) <= 2}
    key, line, probe, sketch = ld.keys(pool, 2, 10)
    order = np.argsort(key, kind="stable")
    rows = key[order], (line * 2 + probe)[order], sketch[order]
    for most in (4, 1000):
        pairs, members = ld.bucket_pairs(*rows, 2, most)
        got = {tuple(p) for p in pairs.tolist()}
        buckets = {}
        for at in members.tolist():
            buckets.setdefault(int(rows[0][at]), set()).add(int(rows[1][at]) >> 1)
        assert bool(members.size) == (most == 4)
        assert all(p in got or any(p[0] in b and p[1] in b for b in buckets.values()) for p in want) and len(want) > 500


def test_meeting_streams_large_and_hot_buckets(monkeypatch):
    """Cut into batches anywhere, with hot keys and with buckets that pass through, no pair is lost."""
    rng = random.Random(4)
    pool = similar_pool(rng, 60) + lines(rng, 30)
    pool = [p for p in dict.fromkeys(pool) if len(p) >= 10]
    want = {(i, j) for i in range(len(pool)) for j in range(i + 1, len(pool)) if ld._plain(pool[i], pool[j]) <= 2}
    key, line, probe, sketch = ld.keys(pool, 2, 10)
    order = np.argsort(key, kind="stable")
    key, mark, sketch = key[order], (line * 2 + probe)[order], sketch[order].view(np.int64)
    for large, hot in ((1 << 16, False), (20, False), (20, True)):
        monkeypatch.setattr(ld, "_LARGE", large)
        salt = ((key % 3 == 0) & hot).astype(np.int16)
        cuts = sorted({0, len(key), *(rng.randrange(len(key)) for _ in range(40))})
        batches = [ld.pa.RecordBatch.from_pydict({"key": key[a:b], "mark": mark[a:b], "sketch": sketch[a:b]} | ({"salt": salt[a:b]} if hot else {})) for a, b in zip(cuts, cuts[1:])]
        rows = [r for b in ld._meet(2)(iter(batches)) for r in b.to_pylist()]
        got = {(r["a"], r["b"]) for r in rows if r["key"] is None}
        buckets = {}
        for r in rows:
            if r["key"] is not None:
                buckets.setdefault(r["key"], set()).add(r["a"])
        assert all(p in got or any(p[0] in b and p[1] in b for b in buckets.values()) for p in want) and len(want) > 50


def test_split_buckets_match_brute_force(spark):
    rng = random.Random(9)
    pool = similar_pool(rng, 70) + ["one of quite other lines " + "".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(60)]
    rng.shuffle(pool)
    later = {j for j in range(len(pool)) for i in range(j) if ld._plain(pool[i], pool[j]) <= 2}
    known = spark.createDataFrame([(100 + i, t, (i,)) for i, t in enumerate(pool)], "line long, words string, place struct<n:int>")
    members = spark.createDataFrame([(k, 100 + i) for i in range(len(pool)) for k in (1, 2 + i % 2)], "key long, line long")
    for most in (8, 80, 4096):
        got = {r.line - 100 for r in ld.bucket_witnesses(members, known, 2, most).collect()}
        assert got == later and len(later) > 20


def test_many_similar_lines(spark):
    """A group of 2000 similar lines gives what brute force gives, and at most one row a line and bucket."""
    rng = random.Random(12)
    pool = list(dict.fromkeys(ld.normal(edits(rng, "a common line that stands in very many documents " + "xyz"[i % 3] * 9, rng.randrange(4))) for i in range(2600)))[:2000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(pool)], "doc_id long, text string").repartition(7)
    i, j = np.triu_indices(len(pool), 1)
    sketch = ld._text_sketches(pool)
    near = np.flatnonzero(ld.sketch_gap(sketch[i], sketch[j]) <= 8)
    near = near[ld.within([pool[k] for k in i[near].tolist()], [pool[k] for k in j[near].tolist()], 2)]
    later = set(j[near].tolist())
    got = {r.doc_id for r in ld.dedup_lines(docs).collect() if r.n_removed}
    assert got == later and len(later) > 1500


def test_lines_of_all_lengths_match_brute_force(spark):
    """Lines of 1 to 40 characters, most of them edited copies of others, across both limits of length."""
    rng = random.Random(21)
    base = ["".join(rng.choice("abcé ") for _ in range(n)) for n in range(1, 41)]
    pool = base + [edits(rng, t, rng.randrange(1, 4)) for t in base for _ in range(3)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6)))) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for full, one in ((ld.MIN_CHARS, ld.ONE_CHARS), (20, 6)):
        want = brute(docs, 2, full, one)
        got = {r.doc_id: (r.text, r.n_removed) for r in ld.dedup_lines(df, 2, full, one).collect()}
        assert got == {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ())), len(want.get(i, ()))) for i, t in docs}
        lengths = {len(ld.normal(docs[d][1].split("\n")[k])) for d, ks in want.items() for k in ks}
        assert min(lengths) < 6 and max(lengths) > 36


def test_short_lines_in_large_buckets(spark):
    """Many lines of 20 characters a letter apart: one edit decides, whatever way a bucket is judged."""
    pool = list(dict.fromkeys(f"same start {a}{b} of all" for a in "abcdefghijkl" for b in "mnopqrstuvwx"))
    order = sorted(range(len(pool)))
    later = {j for j in order for i in order[:j] if ld._plain(pool[i], pool[j]) <= 1}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(pool)], "doc_id long, text string")
    assert {r.doc_id for r in ld.dedup_lines(docs).collect() if r.n_removed} == later and len(later) == len(pool) - 1
    known = spark.createDataFrame([(100 + i, t, (i,)) for i, t in enumerate(pool)], "line long, words string, place struct<n:int>")
    members = known.selectExpr("1L AS key", "line")
    for most in (8, 4096):
        assert {r.line - 100 for r in ld.bucket_witnesses(members, known, 2, most, ld.MIN_CHARS).collect()} == later


def test_short_lines(spark):
    rows = [(1, "all rights reserved."), (2, "All  rights reserved.\nyes"), (3, "all rights reserved!\nyes"), (4, "{\n}\nyes"), (5, "all rights resorved?\nyet")]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "yes", 3: "", 4: "{\n}", 5: rows[4][1]}


def test_clashing_columns(spark):
    names = ["key", "row", "removed", "doc", "line", "n", "__key", "__row", "__removed", "n_removed", "first"]
    rows = [(i, "a line that stands twice in the table", *[f"{c}{i}" for c in names]) for i in (1, 2)]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)))
    assert got.columns == ["doc_id", "text", *names, "n_lines"]
    by = {r.doc_id: r.asDict() for r in got.collect()}
    assert by[1]["text"] == rows[0][1] and by[2]["text"] == "" and by[2]["n_removed"] == 1
    assert all(by[i][c] == f"{c}{i}" for i in (1, 2) for c in names if c != "n_removed")


def test_edge_cases(spark):
    line = "a line that is long enough to be looked at"
    rows = [(1, line, 7), (1, line, 7), (2, line + "\nshort", 7), (None, line.upper(), 7), (3, "x " * 100_000 + "\n" + line, 7), (4, None, 7), (5, "\n\n", 7)]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int"))
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.text, r.n_removed, r.n_lines))
    assert by[1] == [(line, 0, 1)] * 2 and by[2] == [("short", 1, 2)] and by[None] == [("", 1, 1)]
    assert by[3] == [("x " * 100_000, 1, 2)] and by[4] == [(None, 0, 0)] and by[5] == [("\n\n", 0, 3)]
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0

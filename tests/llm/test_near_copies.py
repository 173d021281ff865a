import random

import corpus_pipeline as cp
import numpy as np

from trustfold.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if label[j] < label[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    label[i], changed = label[j], True
    return label


def corpus(rng, groups, copies, words=60):
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, words))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"W{rng.randrange(500)}"
            docs.append(" ".join(t))
    rng.shuffle(docs)
    return list(enumerate(docs))


def check(spark, docs):
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_duplicates(df).collect()} == want
    assert len(set(want.values())) < len(docs)
    return df, want


def test_groups_match_brute_force(spark):
    rng = random.Random(8)
    check(spark, [*corpus(rng, 30, 5), (500, None), (501, ""), (502, "one"), (503, "One"), (504, "one two")])


def test_large_buckets_match_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    docs = corpus(rng, 2, 70, 40)
    # Unlike texts that share a passage, and pairs of copies among them that no centre is part of.
    for i in range(200, 320, 2):
        own = " ".join(f"v{i}x{k}" for k in range(6))
        docs += [(i, f"a b c d e f g h {own}"), (i + 1, f"a b c d e f g h {own} end")]
    monkeypatch.setattr(near_copies, "SAMPLE", 1)  # nothing is known to be common
    check(spark, docs)


def test_stage_finds_copies_beyond_three_bits(spark):
    rng = random.Random(10)
    docs = corpus(rng, 12, 1, 300)
    docs = [(i, f"{t} " + " ".join(f"u{rng.randrange(900)}" for _ in range(100))) for i, t in docs]
    changed = [(100 + i, " ".join(w if k not in (20, 60, 61) else "new" for k, w in enumerate(t.split()))) for i, t in docs]
    df, want = check(spark, docs + changed)
    kept = {r.doc_id for r in dict(cp.STAGES)["simhash_near_dedup"](spark, df, "").collect()}
    assert kept == {i for i, c in want.items() if i == c} == {i for i, _ in docs}


def test_histograms_exclude_no_similar_pair():
    rng = np.random.default_rng(2)
    excluded = 0
    for n in (1, 3, 40, 700, 5000):
        for share in (1.0, 0.95, 0.9, 0.85, 0.5, 0.0):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            y = np.unique(np.concatenate([x[: int(share * len(x))], rng.integers(0, 2**63, max(1, n - int(share * n)) if share < 1 else 0).astype(np.uint64)]))
            if near_copies.similar(x.tobytes(), y.tobytes()):
                assert near_copies.may_be_similar(near_copies.histogram(x), near_copies.histogram(y))
            elif not near_copies.may_be_similar(near_copies.histogram(x), near_copies.histogram(y)):
                excluded += 1
    assert excluded >= 6
    assert near_copies.may_be_similar(near_copies.histogram(x)[:8], near_copies.histogram(y))


def test_clashing_columns(spark):
    from trustfold.llm import simhash

    names = ["__head", "__n", "__row", "head", "n", "doc", "fp", "component_id", "id"]
    text = "the same ten words stand in this text and again"
    rows = [(1, text, *names), (2, text, *names), (3, "b", *names), (3, "a", *names), (None, text, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    want = [rows[0], rows[3], rows[4]]
    for module in (near_copies, simhash):
        got = module.keep_first(docs)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_stage_links_by_fingerprint_and_by_set(spark):
    """A pair within three bits whose sets are unlike, a chain over both kinds of links, and a pair that only its sets link."""
    from .test_simhash import brute_fingerprint

    rng = random.Random(5)
    bits = lambda a, b: (a ^ b).bit_count()
    word = lambda: f"w{rng.randrange(10**6)}"
    base = " ".join(word() for _ in range(12)).split()
    alike = None
    while alike is None:  # twelve words with one changed: sets with a similarity below 0.8
        t = list(base)
        t[rng.randrange(12)] = word()
        if bits(brute_fingerprint(" ".join(base)), brute_fingerprint(" ".join(t))) <= 3:
            alike = t
    assert len(shingles(" ".join(base)) & shingles(" ".join(alike))) < 0.8 * len(shingles(" ".join(base)) | shingles(" ".join(alike)))
    docs = [(1, " ".join(base)), (2, " ".join(alike)), (3, "quite another text"), (4, None), (5, "")]
    docs += [(i + 100, t) for i, t in corpus(rng, 10, 4)]
    ids = [i for i, _ in docs]
    label = brute(docs)
    prints = {i: brute_fingerprint(t or "") for i, t in docs}
    root = {i: label[i] for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if root[j] < root[i] and (label[i] == label[j] or bits(prints[i], prints[j]) <= 3):
                    root[i], changed = root[j], True
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = cp.drop_near_copies(spark, df, "")
    assert {r.doc_id for r in got.collect()} == {i for i in ids if root[i] == i}
    assert root[2] == 1 and label[2] == 2

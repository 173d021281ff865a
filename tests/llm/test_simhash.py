import random

import numpy as np
import xxhash

from trustfold.llm import simhash
from trustfold.llm.components import components


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return dict(zip(ids, label))


def test_fingerprint_matches_plain_definition():
    for text in [None, "", "  \n", "One", "one two", "a b c d A B C", "Äpfel und ÄPFEL\tund\x0bBirnen " * 40, "x y z " * 9000]:
        assert simhash.fingerprint(text.encode() if text is not None else None) == brute_fingerprint(text)


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)] + [0]
    fps = []
    for b in base:
        for _ in range(12):
            f = b
            for _ in range(rng.randrange(5)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    nodes = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "id long, fp long")
    reps = {r["fp"]: r["rep"] for r in nodes.groupBy("fp").agg({"id": "min"}).toDF("fp", "rep").collect()}
    links = simhash.fingerprint_links(nodes.select("fp").distinct()).collect()
    for r in links:
        assert bin((r.fa ^ r.fb) & (2**64 - 1)).count("1") <= 3
    found = components(spark.createDataFrame([(reps[r.fa], reps[r.fb]) for r in links], "u long, v long")).collect()
    got = {r.node: r.component for r in found}
    want = brute_components(list(range(len(fps))), fps)
    assert {i: got.get(reps[n.fp], reps[n.fp]) for n in nodes.collect() for i in [n.id]} == want


def test_large_bucket_gives_a_forest_of_all_links():
    rng = np.random.default_rng(1)
    half = np.uint64(12345)
    high = rng.integers(0, 64, 300, dtype=np.uint64)  # one bucket: equal low halves, six free bits above
    fp = np.unique((high << np.uint64(32)) | half)
    a, b = simhash.bucket_links(np.full(len(fp), half), fp, 3)
    assert len(a) == len(fp) - 1
    assert (np.bitwise_count(a ^ b) <= 3).all()


def test_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "a b", 9), (3, "a b", 9), (None, "a b", 9), (7, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [tuple(r) for r in simhash.near_duplicates(docs.select("doc_id", "text")).orderBy("doc_id").collect()]
    comp = [(g[0], g[2]) for g in got]
    assert comp == [(None, None), (1, 1), (2, 1), (3, 3), (3, 3), (7, 3)]
    assert sorted(str(r.doc_id) for r in simhash.keep_first(docs).collect()) == ["1", "3", "None"]
    assert simhash.near_duplicates(docs.where("false").select("doc_id", "text")).count() == 0


def test_components_long_chain_and_loops(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300}

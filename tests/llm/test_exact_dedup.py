import hashlib
from collections import Counter

import numpy as np
import pytest

from trustfold.llm import exact_dedup
from trustfold.llm.exact_dedup import QuotientFilter, merge


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check(rows, got):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: r.at), rows):
        ids = groups[normal(t)]
        keep = max((x for x in ids if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), i == keep)
        assert r.text_sha256 == hashlib.sha256(normal(t).encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "at int, doc_id long, text string")


@pytest.mark.parametrize("bits", [3, 9, 17, 64])
def test_filters_count_merge_and_pack(bits):
    rng = np.random.default_rng(bits)
    parts = [rng.integers(0, 1 << min(bits, 12), n).astype(np.uint64) * np.uint64(1 if bits < 64 else 3**30) for n in (0, 1, 50, 400)]
    filters = []
    for p in parts:
        fps, n = np.unique(p, return_counts=True)
        f = QuotientFilter.unpack(QuotientFilter.build(fps, n.astype(np.int64), bits).pack())
        assert f.fingerprints().tolist() == fps.tolist() and f.counts.tolist() == n.tolist()
        filters.append(f)
    want = Counter(np.concatenate(parts).tolist())
    whole = merge([merge(filters[:2]), merge(filters[2:])])  # in any order
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist())) == want
    asked = np.array([*want, *(v for v in range(1 << min(bits, 10)) if v not in want)], np.uint64)
    assert whole.count(asked).tolist() == [want[v] for v in asked.tolist()]


def test_repeated_fingerprints(spark):
    rng = np.random.default_rng(1)
    fps = [int(v) for v in rng.integers(-(1 << 62), 1 << 62, 300)]
    fps += fps[:120] + fps[:40] + [-1, -1, 0, 0, 7] * 3
    df = spark.createDataFrame([(v,) for v in fps], "fp long").repartition(9)
    got = {r.fp: r.n for r in exact_dedup.repeated_fingerprints(df, 64).collect()}
    assert got == {v: n for v, n in Counter(fps).items() if n > 1}


@pytest.mark.parametrize("bits", [2, 5, 64])
def test_groups_whatever_collides(spark, bits):
    rng = np.random.default_rng(2)
    texts = ["Hot", "hot", "HOT", "É", "é", "", None, " ", "x" * 300_000, "X" * 300_000, *map(str, range(40))]
    rows = [(int(k), texts[rng.integers(len(texts))]) for k in rng.permutation(300)]
    rows += [(1000 + k, "hOT") for k in range(400)] + [(None, "hot"), (None, "alone"), (None, "alone"), (5000, "again"), (5000, "again")]
    check(rows, exact_dedup.exact_groups(table(spark, rows).repartition(7), bits=bits).collect())


def test_shuffled_routes_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROUTED_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 2)
    rows = [(k, f"t{k % 7}" if k % 3 else f"T{k}") for k in range(200)]
    check(rows, exact_dedup.exact_groups(table(spark, rows)).collect())


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "k", 2, 3, 4, 5), (2, "A", "k", 2, 3, 4, 5)], "doc_id long, text string, kept string, fp int, norm int, hot_n int, doc int")
    got = exact_dedup.exact_groups(df)
    assert got.columns == ["doc_id", "text", "fp", "norm", "hot_n", "doc", "keep_id", "group_size", "kept", "text_sha256"]
    assert {(r.doc_id, r.keep_id, r.kept, r.fp, r.norm, r.hot_n, r.doc) for r in got.collect()} == {(1, 2, False, 2, 3, 4, 5), (2, 2, True, 2, 3, 4, 5)}
    assert exact_dedup.exact_groups(df.where("false")).count() == 0
    (r,) = exact_dedup.drop_copies(df).collect()
    assert (r.doc_id, r.text, r.kept, r.fp) == (2, "A", "k", 2)

import numpy as np

from trustfold.llm import embed_dedup


def make(n=600, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, 24))
    x = centers[rng.integers(0, 8, n)] + rng.normal(scale=0.12, size=(n, 24))
    x[5], x[6], x[7] = x[4], x[4], 2 * x[4]
    return [(i, [float(v) for v in x[i]], int(i % 3) if i > 8 else 1) for i in range(n)]


def brute(rows, least):
    ok = [(i, np.array(v, np.float64), g) for i, v, g in rows]
    unit = [v / np.linalg.norm(v) for _, v, _ in ok]
    near = {i: {j for k2, (j, _, h) in enumerate(ok) if j != i and h == g and unit[k] @ unit[k2] >= least} for k, (i, _, g) in enumerate(ok)}
    comp = {i: i for i in near}
    moved = True
    while moved:
        moved = False
        for i, js in near.items():
            for j in js:
                low = min(comp[i], comp[j])
                if comp[i] != low or comp[j] != low:
                    comp[i] = comp[j] = low
                    moved = True
    return {i: (len(near[i]), comp[i], comp[i] == i) for i in near}


def test_matches_brute_force_also_with_split_buckets(spark):
    rows = make()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows, 0.95)
    assert max(n for n, _, _ in want.values()) > 5
    for split in (4096, 16):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df, 0.95, split=split).collect()}
        links = sum(n for n, _, _ in want.values())
        assert sum(n for n, _, _ in got.values()) >= 0.99 * links
        assert all(got[i][0] <= want[i][0] for i in got)
        assert sum(got[i] == want[i] for i in got) >= 0.97 * len(want)


def test_links_are_reported_once(spark):
    df = spark.createDataFrame([(i, 1, v) for i, v, _ in make(200)][8:], "rep long, grp long, embedding array<double>")
    pairs = [(r.a, r.b) for r in embed_dedup.vector_links(df, 0.9, split=16).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs) and len(pairs) > 100


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1, 9), (2, [1.0, 0.0], 1, 9), (3, [1.0, 0.0], None, 9), (4, None, 1, 9), (5, [0.0, 0.0], 1, 9), (6, [nan, 1.0], 1, 9),
        (7, [inf, 1.0], 1, 9), (8, [None, 1.0], 1, 9), (9, [], 1, 9), (None, [1.0, 0.0], 1, 9), (10, [1.0, 0.0, 0.0], 1, 9), (1, [1.0, 0.0], 1, 9),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embed_dedup.near_vectors(df).collect())
    assert got == sorted(
        [("1", 2, "1", True)] * 2 + [("2", 2, "1", False), ("None", 0, "None", True)] + [(str(i), 0, str(i), True) for i in range(3, 11)]
    )
    assert embed_dedup.near_vectors(df.where("false")).count() == 0

import numpy as np
from pyspark.sql import functions as F

from trustfold.llm import mixing


def docs(spark, n=600):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        s = "big" if rng.random() < 0.7 else f"s{rng.integers(3)}"
        rows.append((i, " ".join(["w"] * int(rng.integers(1, 40))), ["en", "de", None][int(rng.integers(3))], s))
    rows += [(None, "a b", "en", None), (700, None, "en", "big"), (701, "", "fr", "s0"), (5, rows[5][1], rows[5][2], rows[5][3])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def brute(cells, alpha):
    """Plain raking over {(source, lang, topic): tokens}."""
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    goals = []
    for d in range(3):
        sums = {}
        for k, v in cells.items():
            sums[k[d]] = sums.get(k[d], 0) + v
        norm = sum(v**alpha for v in sums.values() if v)
        goals.append({k: v**alpha / norm if v else 0.0 for k, v in sums.items()})
    for _ in range(200):
        for d in range(3):
            now = {}
            for k, v in w.items():
                now[k[d]] = now.get(k[d], 0) + v
            w = {k: v * goals[d][k[d]] / now[k[d]] if now[k[d]] else 0.0 for k, v in w.items()}
    return w


def test_weights_match_plain_raking_and_meet_the_budget(spark):
    df = docs(spark)
    got = mixing.mix(df, keep_share=0.4, rounds=40).collect()
    assert len(got) == df.count()
    cells = {}
    for r in got:
        k = (r.mix_source, r.mix_lang, r.mix_topic)
        cells[k] = cells.get(k, 0) + r.n_tokens
    want = brute(cells, 0.5)
    for r in got:
        if r.n_tokens:
            assert abs(r.mix_weight - want[r.mix_source, r.mix_lang, r.mix_topic]) < 1e-8
    total = sum(cells.values())
    assert abs(sum(r.n_tokens * r.mix_prob for r in got) / total - 0.4) < 1e-6
    assert all(0 <= r.mix_prob <= 1 for r in got)
    assert all(r.mix_keep for r in got if r.n_tokens == 0)
    kept = sum(r.n_tokens for r in got if r.mix_keep) / total
    assert abs(kept - 0.4) < 0.08
    assert len({r.mix_keep for r in got if r.doc_id == 5}) == 1


def test_given_targets_and_empty(spark):
    df = docs(spark).where("lang is not null and source is not null and text <> ''")
    goal = spark.createDataFrame([("en", 0.9), ("de", 0.1), ("fr", 0.0)], "mix_lang string, target double")
    got = mixing.mix(df, targets={"mix_lang": goal}, rounds=40).groupBy("mix_lang", "mix_source", "mix_topic").agg(F.max("mix_weight").alias("w")).groupBy("mix_lang").agg(F.sum("w").alias("w")).collect()
    share = {r.mix_lang: r.w for r in got}
    assert abs(share["en"] - 0.9) < 0.02
    assert mixing.mix(df.where("false")).count() == 0


def test_clashing_columns_pass(spark):
    df = docs(spark, 50).withColumns({"tokens": F.lit("x"), "weight": F.lit(1), "target": F.lit(2)})
    assert {"tokens", "weight", "target"} <= set(mixing.mix(df).columns)

import random

import corpus_pipeline as cp
import duckdb

from trustfold.llm import decontaminate, line_dedup, queries

from .test_decontaminate import semi_global
from .test_line_dedup import brute
from .test_simhash import brute_components, brute_fingerprint


def fixture(spark, folder):
    rng = random.Random(11)
    words = {"xx": "lorem ipsum dolor sit amet consectetur elit sed".split(), "yy": "kaze hito yama kawa sora mizu tsuki hana".split()}
    line = lambda k: " ".join(rng.choice(words[k]) + str(rng.randrange(9)) for _ in range(9))
    item = line("xx")
    pool = {k: [line(k) for _ in range(12)] for k in words}
    rows = []
    for i in range(160):
        k = ["xx", "yy"][i % 3 == 0]
        parts = [rng.choice(pool[k]) if rng.random() < 0.15 else line(k) for _ in range(rng.randrange(1, 6))]
        if i % 40 == 5:
            parts.append(line(k) + " " + item[:30] + "q" + item[30:] + " " + line(k))
        rows.append([i, "\n".join(parts), k, f"src{i % 4 and 1}", 0])
    rows[50][1] = rows[20][1] + " one"
    rows += [[200, None, "xx", "src1", 0], [201, "123 456", "xx", "src1", 6], [202, rows[3][1], "yy", None, 0], [None, line("xx"), None, "src1", 0]]
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_stages_match_brute_force(spark, tmp_path):
    item = decontaminate.normal(fixture(spark, tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    steps = dict(cp.STAGES)
    take = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))

    one = steps["language_id"](spark, docs, str(tmp_path))
    assert one.columns == columns
    assert {r[0] for r in take(docs)} - {r[0] for r in take(one)} == {200, 201}

    rows = take(one)
    gone = brute(rows, line_dedup.BUDGET, line_dedup.MIN_CHARS)
    want = []
    for d, (i, t) in enumerate(rows):
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ()))
        if kept.strip() or not t.strip():
            want.append((i, kept))
    two = steps["line_dedup"](spark, one, str(tmp_path))
    assert two.columns == columns and take(two) == want and len(want) < len(rows) and gone
    assert all(r.n_chars == len(r.text) for r in two.collect())

    ids = [i for i, _ in want if i is not None]
    comp = brute_components(ids, [brute_fingerprint(t) for i, t in want if i is not None])
    three = steps["simhash_near_dedup"](spark, two, str(tmp_path))
    assert three.columns == columns and take(three) == [(i, t) for i, t in want if i is None or comp[i] == i]

    rows = take(three)
    clean = [(i, t) for i, t in rows if semi_global(item, decontaminate.normal(t))[0] > len(item) // 10]
    four = steps["benchmark_decontamination"](spark, three, str(tmp_path))
    assert four.columns == columns and take(four) == clean and len(clean) < len(rows)

    five = steps["mixing"](spark, four, str(tmp_path))
    four.write.parquet(f"{tmp_path}/four.parquet")
    sql = queries.op7_sql(f"read_parquet('{tmp_path}/four.parquet/*.parquet')", "SELECT doc_id, text FROM o WHERE draw < round(p,9)")
    assert take(five) == sorted(duckdb.sql(sql).fetchall(), key=lambda r: (r[0] is None, r[0] or 0))
    assert 0 < five.count() < four.count()


def test_run_is_the_stages(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert sorted(cp.run(spark, str(tmp_path)).collect(), key=key) == sorted(docs.collect(), key=key)


def test_empty_documents(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0

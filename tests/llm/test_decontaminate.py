import random

from trustfold.llm import decontaminate as d


def semi_global(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    best = min(row)
    return best, row.index(best)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        at, how = rng.randrange(len(t)), rng.randrange(3)
        if how == 0:
            t[at] = rng.choice("abcdefé ")
        elif how == 1:
            del t[at]
        else:
            t.insert(at, rng.choice("abcdefé"))
    return "".join(t)


def test_matches_brute_force():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [d.normal(prose(rng.randrange(12, 60))) for _ in range(12)]
    texts = [None, "", prose(5)]
    for i in range(60):
        t = prose(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)
            t += " " + edited(rng, item, rng.randrange(0, int(len(item) * 0.14) + 1)).upper() + "\n " + prose(rng.randrange(0, 30))
        texts.append(t)
    m = d.Matcher(items, 0.1)
    got, want = m.match(texts), {}
    for n, t in enumerate(texts):
        for i, item in enumerate(items):
            if t:
                e, end = semi_global(item, d.normal(t))
                if e <= m.budget[i]:
                    want[n, i] = (e, end)
    assert len(want) > 30 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == want[k][1] for k in want)


def test_table_cases(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame(
        [(1, "x " * 200_000 + item.upper(), "a"), (2, None, "a"), (3, "", "a"), (4, "clean words only", "a"), (None, item, "a"), (5, item, "a"), (5, item, "a")],
        "doc_id long, text string, item_id string",
    )
    bench = spark.createDataFrame([(1, item), (2, item), (3, "absent"), (4, None), (5, " "), (None, item)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.edits) for r in d.best_matches(docs, bench).collect())
    assert got == [("1", 1, 0), ("1", 2, 0), ("5", 1, 0), ("5", 2, 0), ("None", 1, 0), ("None", 2, 0)]
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [2, 3, 4]
    assert d.clean(docs, bench.where("false")).count() == 7
    assert d.best_matches(docs.where("false"), bench).count() == 0


def test_items_of_all_lengths_match_brute_force(spark):
    """A very long item beside short ones; items too short for an edit stand unchanged between word bounds; blocks change nothing."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(700), prose(40), "who was it then", "one two", prose(15), "capital of france is paris", "hamlet", "q"]
    docs = [(i, prose(8) + " " + edited(rng, items[i % 2], 5) + " " + prose(5)) for i in range(4)]
    docs += [(10, "He asked: who WAS\n it then and went"), (11, "who was it thence"), (12, "awho wes it then"), (13, "who was it then"), (14, "one two three"), (15, "one twos"), (16, "bone two")]
    docs += [(17, "q: who wrote hamlet ? a"), (18, "Hamlets"), (19, "the capitol of france is paris, not rome"), (20, "capitol of france is parys"), (21, "hamlet"), (22, "hamle t"), (23, "q"), (24, "qq qa")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(f"item {k}", t) for k, t in enumerate(items)], "item_id string, text string")
    want = {}
    for i, t in docs:
        for k, item in enumerate(map(d.normal, items)):
            text, budget = d.normal(t), len(d.normal(item)) // 10
            edits = semi_global(item, text)[0] if budget else 0 if f" {item} " in f" {text} " else 1
            if edits <= budget:
                want[i, f"item {k}"] = edits
    for chars in (d.BLOCK_CHARS, 300):
        got = {(r.doc_id, r.item_id): r.edits for r in d.contaminated(df, bench, block_chars=chars).collect()}
        assert got == want
    found = {i for i, _ in want}
    assert {10, 11, 12, 13, 14, 17, 19, 20, 21, 23} <= found and not found & {15, 16, 18, 22, 24}
    sizes = d.Matcher([d.normal(t) for t in items], 0.1)
    assert len(sizes.masks) < 1.5 * (len(sizes.length) + sum(sizes.length) / 64) * len(set("".join(items))) + 64 * len(items)


def test_short_items_by_chance(spark):
    """Items of one to three words against texts of the same few words."""
    rng = random.Random(16)
    prose = lambda n: " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    items = [d.normal(prose(1 + i % 3)) for i in range(60)]
    texts = [prose(3) + " " + edited(rng, rng.choice(items) + "   ", rng.randrange(3)) + prose(3) for _ in range(120)]
    m, want = d.Matcher(items, 0.1), {}
    for n, t in enumerate(map(d.normal, texts)):
        for i, item in enumerate(items):
            if m.budget[i]:
                edits, end = semi_global(item, t)
                if edits <= m.budget[i]:
                    want[n, i] = (edits, end)
            elif f" {item} " in f" {t} ":
                want[n, i] = (0, f" {t} ".index(f" {item} ") + len(item))
    assert m.match(texts) == want and sum(e > 0 for e, _ in want.values()) > 5 and sum(m.budget[i] == 0 for _, i in want) > 20


def test_clashing_columns(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    names = ["key", "doc", "__key", "__bad", "item_id", "edits", "end"]
    rows = [(1, item, *names), (2, "clean", *names), (2, "clean", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = d.clean(docs, spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows[1:], key=str)


def test_query_matches_brute_force(spark, tmp_path):
    from trustfold.llm import queries

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(12) for _ in range(5)]
    docs = [(i, prose(20) + " " + (edited(rng, items[i % 5], rng.randrange(9)) if i % 3 else "") + " " + prose(4)) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for i, t in docs:
        for k, item in enumerate(items):
            e, end = semi_global(d.normal(item), d.normal(t))
            if e <= len(d.normal(item)) // 10:
                want.add((i, k, e, end))
    got = {(r.doc_id, r.item_id, r.edits, r.end) for r in queries.op6_decontamination(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 8

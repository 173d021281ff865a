import numpy as np
from pyspark.sql import functions as F

from trustfold.llm import langid

WORDS = {"xx": "lorem ipsum dolor sit amet", "yy": "kaze hito yama kawa sora"}


def rows(n):
    rng = np.random.default_rng(5)
    return [(i, " ".join(rng.choice(WORDS[k].split(), 12)), k) for i in range(n) for k in [["xx", "yy"][i % 2]]]


def test_learns_and_rejects(spark):
    train = spark.createDataFrame(rows(300), "doc_id long, text string, lang string")
    model = langid.fit(train, sample_rows=200)
    asked = [(1, "dolor amet ipsum", 5), (2, "yama kaze", 5), (3, None, 5), (4, "123 !!", 5), (5, "", 5), (6, "sora " * 300_000, 5)]
    got = langid.identify(spark.createDataFrame(asked, "doc_id long, text string, score int"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["xx", "yy", "und", "und", "und", "yy"]
    assert [r.rejected for r in got] == [False, False, True, True, True, False]
    assert all(0 <= r.score <= 1 for r in got)


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([(1, "abc", None), (None, "abc", "xx")], "doc_id long, text string, lang string")
    assert langid.fit(none) is None
    assert langid.identify(none, None).select("lang_pred").distinct().collect()[0][0] == "und"
    model = langid.fit(spark.createDataFrame(rows(20), "doc_id long, text string, lang string"))
    assert langid.identify(none.where("false"), model).count() == 0


def test_grams_do_not_cross_texts():
    one, _ = langid.gram_buckets([b"abc", None, b"def"])
    parts = [langid.gram_buckets([t])[0] for t in (b"abc", b"", b"def")]
    assert one.tolist() == np.concatenate(parts).tolist()


def test_rejection_of_garbled_and_unlearned_texts(spark):
    """On the given documents: held-out texts of learned languages stay, garbled ones and those of a language that was left out go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    held = [r for r in docs.where((fold == 1) & F.col("text").isNotNull() & F.col("lang").isNotNull()).collect() if len(r.text) >= 300]
    model = langid.fit(docs.where((fold != 1) & (F.col("lang") != "fr")))

    def rejected(texts):
        asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return langid.identify(asked, model).select(F.avg(F.col("rejected").cast("int"))).first()[0]

    known = [r.text for r in held if r.lang != "fr"]
    assert rejected(known) < 0.02
    assert rejected([langid.garbled(t, 3, fresh) for t in known for fresh in (True, False)]) > 0.9
    assert rejected([r.text for r in held if r.lang == "fr"]) > 0.7
    assert 0 <= model.false_accept < 0.6


def test_prediction_is_a_plain_forward_pass(spark):
    model = langid.fit(spark.createDataFrame(rows(100), "doc_id long, text string, lang string"))
    texts = ["Lorem ipsum", "kaze  HITO", "a", "é ü", "x" * 3000]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        raw = b"  " + "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in t).encode() + b"  "
        sums = np.zeros(len(model.bias))
        for k in range(len(raw) - 3):
            gram = int.from_bytes(raw[k : k + 4], "little")
            sums += model.scores[:, ((gram * 2654435761) & 0xFFFFFFFF) >> (32 - langid.BUCKET_BITS)]
        z = (sums / (len(raw) - 3) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        for r in (got[i], got[i + len(texts)]):  # repeated rows are judged alike
            assert r.lang_pred == model.labels[int(p[:-1].argmax())] and abs(r.score - p[:-1].max()) < 1e-6


def test_one_step_of_descent_matches_plain_gradients():
    rng = np.random.default_rng(4)
    x = rng.random((6, 20)).astype(np.float32)
    x /= x.sum(axis=1, keepdims=True)
    y = np.array([0, 1, 2, 0, 1, 2])
    shares = langid.Shares(np.arange(0, 121, 20), np.tile(np.arange(20), 6), x.reshape(-1))
    got = langid.train(shares, 20, y, np.zeros(6, bool), ["a", "b"], width=3, epochs=1, rate=2.0, batch=6, calibration=0.0, seed=1)
    same = np.random.default_rng(1)
    order = same.permutation(6)
    e = same.uniform(-1, 1, (20, 3)).astype(np.float32) / 3
    w = same.normal(0, 0.1, (3, 3)).astype(np.float32)
    b = np.zeros(3)
    loss = lambda e, w, b: -np.mean([np.log(langid._softmax((x[i] @ e @ w + b)[None])[0, y[i]]) for i in order])

    def slope(f, v):
        out, h = np.zeros(v.shape), 1e-4
        for at in np.ndindex(v.shape):
            up, down = v.astype(np.float64).copy(), v.astype(np.float64).copy()
            up[at] += h
            down[at] -= h
            out[at] = (f(up) - f(down)) / (2 * h)
        return out

    e1, w1, b1 = e - 2.0 * slope(lambda v: loss(v, w, b), e), w - 0.2 * slope(lambda v: loss(e, v, b), w), b - 0.02 * slope(lambda v: loss(e, w, v), b)
    assert np.allclose(got.scores, (e1 @ w1).T, atol=1e-4) and np.allclose(got.bias, b1, atol=1e-4)


def test_small_samples_train_to_the_end(spark):
    """Held-out accuracy on the given documents, from 100, 200 and 400 labelled rows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    train, held = docs.where(fold != 1), docs.where((fold == 1) & (F.col("doc_id") < 1500))
    for n in (100, 200, 400):
        got = langid.identify(held, langid.fit(train, sample_rows=n))
        assert got.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.97, n


def test_the_driver_sees_the_model_only(spark, monkeypatch):
    """Rows of the sample stay in a task; a table without usable rows has no model."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    def refused(self):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr(Classic, "toArrow", refused)
    monkeypatch.setattr(Classic, "toPandas", refused)
    words = {"a": "alpha beta gamma delta", "b": "uno dos tres cuatro"}
    rows = [(i, f"{words['ab'[i % 2]]} {i}", "ab"[i % 2]) for i in range(60)]
    kinds = "doc_id bigint, text string, lang string"
    assert langid.fit(spark.createDataFrame(rows, kinds)).labels == ["a", "b"]
    assert langid.fit(spark.createDataFrame([(1, None, "a"), (2, "12", "b")], kinds)) is None

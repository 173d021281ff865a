"""Language identification with averaged hashed subword embeddings.

A text is lower-cased (A-Z), its ASCII non-letters become spaces, and all byte 4-grams within it (two
spaces stand before and after) are hashed to buckets. The mean of the buckets' embeddings goes
through a linear softmax. Embeddings and weights are trained together by stochastic gradient descent in
numpy on the driver, on a bounded sample of labelled rows, however few they are for LEAST_STEPS batches at least; at prediction time embeddings and weights are
folded into one table of per-bucket class scores, so that memory is small and fixed.

Rejection is calibrated. Of some sampled texts garbled versions (their letters shuffled, or drawn anew) train a class of noise,
and short stretches of some train their language, as a text may be one word. On a calibration part of the sample a temperature is
fitted; a document's score is the probability of its best language, the noise among the alternatives, and it is
rejected if that is below the threshold under which only ``false_reject`` of the right calibration answers fall. Texts of less than
``SHORT_BYTES`` say less, and have a threshold of their own; both are lowered by ``margin`` in log odds, as the calibration part is small, and are ``most`` at most. The model also carries the share of garbled calibration texts above
the thresholds (``false_accept``).
Texts that are null or have no letter are ``und`` and rejected.

Defined cases: rows without language or id do not train; with no labelled row at all every text is ``und``
with score zero. Repeated rows are predicted alike; very long texts are read whole; other
columns pass through unless they are named lang_pred, score or rejected, which are replaced.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

BUCKET_BITS = 13
SHORT_BYTES = 200
_CHUNK = 1 << 18
_LETTERS = re.compile(r"[^\W\d_]")


def _clean_table() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[65:91] = np.arange(97, 123)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def gram_buckets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 4-grams of all texts, and each text's first position among them."""
    parts = [b"  " + (t or b"") + b"  " for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    data = _clean_table()[np.frombuffer(b"".join(parts), np.uint8)].astype(np.uint32)
    gram = data[:-3] | (data[1:-2] << np.uint32(8)) | (data[2:-1] << np.uint32(16)) | (data[3:] << np.uint32(24))
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    # Grams across two texts are dropped, and those of spaces only keep their place in bucket 0.
    ends = np.cumsum(size)
    keep = np.ones(len(bucket), bool)
    for back in (1, 2, 3):
        keep[ends[:-1] - back] = False
    starts = np.concatenate([[0], np.cumsum(size - 3)[:-1]])
    return bucket[keep], starts


@dataclass
class LanguageModel:
    labels: list[str]
    scores: np.ndarray  # labels and noise x buckets: embeddings times weights
    bias: np.ndarray
    temperature: float
    threshold: float
    short_threshold: float
    false_accept: float

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        out, at = np.zeros((len(texts), len(self.bias)), np.float64), 0
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and (end == at or total + len(texts[end] or b"") <= _CHUNK):
                total += len(texts[end] or b"")
                end += 1
            bucket, starts = gram_buckets(texts[at:end])
            count = np.diff(np.concatenate([starts, [len(bucket)]]))
            for k in range(len(self.bias)):
                out[at:end, k] = np.add.reduceat(self.scores[k][bucket], starts, dtype=np.float64) / count
            at = end
        return out + self.bias

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        """Of the languages; what is left to one is the noise's."""
        return _softmax(self.logits(texts) / self.temperature)[:, :-1]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def garbled(text: str, seed: int, fresh: bool) -> str:
    """The text with its letters and signs shuffled over its words, or drawn anew from a to z."""
    rng = np.random.default_rng(seed)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    word = np.flatnonzero(code > 32)
    code[word] = rng.integers(97, 123, len(word)) if fresh else rng.permutation(code[word])
    return code.tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class Shares:
    """Rows of bucket shares: row i holds ``at`` and ``share`` from first[i] to first[i + 1]."""

    first: np.ndarray
    at: np.ndarray
    share: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the row in ``rows``, bucket, share)."""
        size = self.first[rows + 1] - self.first[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        place = np.arange(len(owner)) + np.repeat(self.first[rows] - (np.cumsum(size) - size), size)
        return owner, self.at[place], self.share[place]

    def mean(self, rows: np.ndarray, e: np.ndarray) -> np.ndarray:
        owner, at, share = self.take(rows)
        return np.add.reduceat(e[at] * share[:, None], np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)


def train(
    x: Shares, buckets: int, y: np.ndarray, short: np.ndarray, labels: list[str], width: int = 16, epochs: int = 12, rate: float = 40.0, batch: int = 64, seed: int = 7, calibration: float = 0.25,
    false_reject: float = 0.001, margin: float = 1.5, most: float = 0.9, least_steps: int = 0,
) -> LanguageModel:
    """x: rows of bucket shares; y: label numbers, len(labels) for noise; short: of short texts. SGD on softmax(mean embedding @ weights + bias).

    There are ``epochs`` passes, or as many as give ``least_steps`` batches.
    """
    rng = np.random.default_rng(seed)
    n, k = len(y), len(labels) + 1
    held = rng.permutation(n)
    cut = max(1, int(n * (1 - calibration)))
    fit, cal = held[:cut], held[cut:] if cut < n else held
    e = rng.uniform(-1, 1, (buckets, width)).astype(np.float32) / width
    w, b = rng.normal(0, 0.1, (width, k)).astype(np.float32), np.zeros(k, np.float32)
    target = np.eye(k, dtype=np.float32)[y]
    epochs = max(epochs, -(-least_steps // -(-len(fit) // batch)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            i = fit[at : at + batch]
            h = x.mean(i, e)
            g = (_softmax(h @ w + b) - target[i]) / len(i)
            owner, at_bucket, share = x.take(i)
            pull = (g @ w.T)[owner] * share[:, None]
            ge = np.stack([np.bincount(at_bucket, pull[:, d], buckets) for d in range(width)], axis=1)
            w -= step * 0.1 * (h.T @ g)
            b -= step * 0.01 * g.sum(axis=0)
            e -= (step * ge).astype(np.float32)
    z = (x.mean(cal, e @ w) + b).astype(np.float64)
    right = y[cal]
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(right)), right], 1e-12)).mean()
    temperature = min(np.geomspace(0.1, 10, 61).tolist(), key=loss)
    p = _softmax(z / temperature)[:, :-1]
    good, noise = (p.argmax(axis=1) == right) & (right < k - 1), right == k - 1
    top, few = p.max(axis=1), short[cal]
    low = lambda q: q / (q + (1 - q) * np.exp(margin))
    at = lambda some: min(most, float(low(np.quantile(top[some], false_reject)))) if some.any() else 0.0
    limits = at(good & ~few), at(good & few)
    accept = float((top[noise] >= np.where(few[noise], limits[1], limits[0])).mean()) if noise.any() else 0.0
    return LanguageModel(labels, np.ascontiguousarray((e @ w).T, np.float32), b.astype(np.float64), temperature, *limits, accept)


#: Steps of descent that a small sample gets too; 12 epochs of the whole sample are about as many.
LEAST_STEPS = 600


def fit(docs: DataFrame, sample_rows: int = 2048, seed: int = 7) -> LanguageModel | None:
    """Train on at most ``sample_rows`` rows of docs(doc_id, text, lang), those with the least hashes.

    The bound is on rows; each is read whole and reduced on the executors to its bucket counts. Half of them also give a
    garbled version, a short stretch and that one garbled, so three rows of counts for each sampled row are the bound in memory.
    """
    usable = docs.where("doc_id is not null and text is not null and lang is not null")
    ids = usable.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_rows).select("doc_id").distinct()

    def counted(frames):
        for frame in frames:
            out = []
            for i, (text, h) in enumerate(zip(frame["text"], frame["h"])):
                if not _LETTERS.search(text):
                    continue
                some = [("text", text)]
                pick = h & 7
                if pick < 4:
                    some.append(("noise", garbled(text, h & 0xFFFF, pick == 0)))
                    words = text.split()
                    at, n = (h >> 3 & 0xFFFF) % max(1, len(words)), 1 + (h >> 19 & 7)
                    short = " ".join(words[at : at + n])
                    some += [("text", short), ("noise", garbled(short, h & 0xFFFF, pick == 1))] if _LETTERS.search(short) else []
                for kind, t in some:
                    bucket, _ = gram_buckets([t.encode("utf-8", "surrogatepass")])
                    count = np.bincount(bucket, minlength=1 << BUCKET_BITS)
                    on = np.flatnonzero(count)
                    out.append((frame["doc_id"][i], frame["lang"][i] if kind == "text" else None, h, on.tolist(), count[on].tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "h", "at", "n"])

    picked = usable.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", F.xxhash64("text").alias("h"), "text")
    counts = picked.mapInPandas(counted, f"doc_id {dict(picked.dtypes)['doc_id']}, lang string, h bigint, at array<int>, n array<int>")
    # Ids may repeat; the limit holds for rows. The sample is trained on in a task, so that the driver sees the model only.
    rows = counts.orderBy("doc_id", "h", "lang", F.hash("at", "n")).limit(3 * sample_rows).select("lang", "at", "n")

    def trained(batches):
        rows = pa.Table.from_batches(batches, pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]))
        model = _train_on(rows, seed)
        yield pa.RecordBatch.from_arrays([pa.array([] if model is None else [pickle.dumps(model)], pa.binary())], names=["model"])

    got = rows.coalesce(1).mapInArrow(trained, "model binary").collect()
    return pickle.loads(got[0].model) if got else None


def _train_on(rows: pa.Table, seed: int) -> LanguageModel | None:
    """The model of rows(lang, at, n) of bucket counts; null languages are noise."""
    if not rows.num_rows:
        return None
    langs = rows.column("lang").to_pylist()
    lists = rows.column("at").combine_chunks()
    size, at = np.array(lists.value_lengths(), np.int64), np.array(lists.flatten())
    first = np.concatenate([[0], np.cumsum(size)])
    n = rows.column("n").combine_chunks().flatten().to_numpy()
    total = np.add.reduceat(n, first[:-1], dtype=np.int64)
    share = n.astype(np.float32)
    share /= np.repeat(total.astype(np.float32), size)
    labels = sorted({v for v in langs if v is not None})
    y = np.array([labels.index(v) if v is not None else len(labels) for v in langs])
    # A text has a gram a byte and one more.
    return train(Shares(first, at, share), 1 << BUCKET_BITS, y, total <= SHORT_BYTES, labels, seed=seed, least_steps=LEAST_STEPS)


def predict_udf(model: LanguageModel):
    @F.arrow_udf("struct<lang:string,score:double>")
    def of(text: pa.Array) -> pa.Array:
        parts = [model.probabilities(t.cast(pa.large_binary()).to_pylist()) for _, t in text_slices(text)]
        p = np.concatenate([np.zeros((0, len(model.labels))), *parts])
        best = p.argmax(axis=1)
        lang = pa.array(np.array(model.labels, object)[best], pa.string())
        return pa.StructArray.from_arrays([lang, pa.array(p.max(axis=1, initial=0.0))], names=["lang", "score"])

    return of


def identify(docs: DataFrame, model: LanguageModel | None, text: Column | None = None) -> DataFrame:
    """Add lang_pred, score and rejected to every row of ``docs``, from its text alone."""
    text = F.col("text") if text is None else text
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    asked = docs.withColumn("__said", predict_udf(model)(text))
    return asked.withColumns(
        {
            "lang_pred": F.when(letters, F.col("__said.lang")).otherwise("und"),
            "score": F.when(letters, F.col("__said.score")).otherwise(0.0),
            "rejected": ~letters | (F.col("__said.score") < F.when(F.octet_length(text) < SHORT_BYTES, model.short_threshold).otherwise(model.threshold)),
        }
    ).drop("__said")

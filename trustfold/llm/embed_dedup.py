"""Embedding near-duplicates by cross-polytope hashing.

Vectors are scaled to length one, padded to a power of two and rotated by three rounds of random signs and
fast Hadamard transforms. A code is the nearest signed axis; a table joins the codes of two rotations. Each
vector is indexed under its own code and probes the next-nearest axis of either rotation.
Vectors that share a bucket, of which one is there by its own code, are compared by cosine in double precision.
A pair is reported once only: in the first table where it meets.

Only vectors of one group (label) and one dimension meet, as both are part of the bucket key. Equal
vectors are one class before hashing. Buckets of more than ``split`` rows are dealt to a triangle of
smaller tasks, so that no task holds more than about two parts of such a bucket.

An id that stands on rows with different vectors is one vertex.

Defined cases: a null label or id, a vector that is null, empty, zero, or holds null or non-finite
components links with nothing, and is its own component (null for a null id). Repeated rows and ties
are classes of equal vectors, linked with each other. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_tasks, written
from .components import components

#: More hot buckets than this are joined by a shuffle instead of a broadcast.
BROADCAST_HOT = 50_000
_PROBES = 3


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(unit: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """rows x tables x 3: own code, then the two probes."""
    size = 1 << max(1, (unit.shape[1] - 1).bit_length())
    unit = np.pad(unit, ((0, 0), (0, size - unit.shape[1])))
    rng, out = np.random.default_rng(seed), np.empty((len(unit), tables, _PROBES), np.int64)
    for t in range(tables):
        best, second = [], []
        for _ in range(2):
            x = unit
            for signs in rng.choice([-1.0, 1.0], (3, size)):
                x = _hadamard(x * signs)
            top = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
            value = np.take_along_axis(x, top, axis=1)
            swap = np.abs(value[:, 1]) > np.abs(value[:, 0])
            signed = 2 * top + (value > 0)
            best.append(np.where(swap, signed[:, 1], signed[:, 0]))
            second.append(np.where(swap, signed[:, 0], signed[:, 1]))
        join = lambda a, b: a * (2 * size) + b
        out[:, t, 0], out[:, t, 1], out[:, t, 2] = join(best[0], best[1]), join(second[0], best[1]), join(best[0], second[1])
    return out


def _mix(*parts) -> np.ndarray:
    """A 64-bit hash of integer columns."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(29))
    return h.view(np.int64)


ROWS = "key bigint, own boolean, tab int, rep bigint, grp bigint, codes binary, vec binary"


def _hash_rows(tables: int, seed: int, keys_only: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, grp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            vectors = batch.column(2)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            first = vectors.offsets.to_numpy() - vectors.offsets.to_numpy()[0]
            for dim in np.unique(lengths):
                every = np.flatnonzero(lengths == dim)
                for at in range(0, len(every), 1024):
                    rows = every[at : at + 1024]
                    x = flat[first[rows][:, None] + np.arange(dim)[None, :]]
                    unit = x.astype(np.float64)
                    unit /= np.abs(unit).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    code = codes(unit, tables, seed)
                    n = len(rows)
                    tab = np.broadcast_to(np.arange(tables)[None, :, None], code.shape)
                    wide = lambda a: np.broadcast_to(a[rows][:, None, None], code.shape)  # noqa: E731, B023
                    key = _mix(wide(grp), np.full(code.shape, dim), tab, code).reshape(-1)
                    if keys_only:
                        yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])
                        continue
                    flatcodes, raw = code.reshape(n, -1), np.ascontiguousarray(x)
                    texts = np.repeat(np.arange(n), tables * _PROBES)
                    coded, vec = [c.tobytes() for c in flatcodes], [v.tobytes() for v in raw]
                    own = np.broadcast_to(np.array([True, False, False])[None, None, :], code.shape).reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key), pa.array(own), pa.array(tab.reshape(-1).astype(np.int32)), pa.array(wide(rep).reshape(-1).astype(np.int64)),
                            pa.array(wide(grp).reshape(-1).astype(np.int64)), pa.array([coded[i] for i in texts], pa.binary()), pa.array([vec[i] for i in texts], pa.binary()),
                        ],
                        names=["key", "own", "tab", "rep", "grp", "codes", "vec"],
                    )

    return of


class _Bucket:
    """The rows of one bucket (or of one part pair of a split bucket)."""

    def __init__(self, table: pa.Table, tables: int, dtype: str) -> None:
        get = lambda c: table.column(c).to_numpy()
        self.own, self.rep, self.grp, self.salt = get("own"), get("rep"), get("grp"), get("salt")
        self.tab, self.cross = int(get("tab")[0]), bool(get("cross")[0])
        self.codes = np.stack([np.frombuffer(b, np.int64).reshape(tables, _PROBES) for b in table.column("codes").to_pylist()])
        x = np.stack([np.frombuffer(b, dtype) for b in table.column("vec").to_pylist()]).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def pairs(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        owners = np.flatnonzero(self.own)
        for at in range(0, len(owners), 512):
            some = owners[at : at + 512]
            i, j = np.nonzero(self.unit[some] @ self.unit.T >= least)
            i = some[i]
            ok = (self.rep[i] != self.rep[j]) & (self.grp[i] == self.grp[j])
            ok &= ~self.own[j] | (self.rep[i] < self.rep[j])
            if self.cross:
                ok &= self.salt[i] != self.salt[j]
            i, j = i[ok], j[ok]
            a, b = self.codes[i], self.codes[j]
            met = np.zeros(len(i), bool)
            for t in range(self.tab):  # an earlier table has this pair
                met |= (a[:, t, :1] == b[:, t]).any(axis=1) | (b[:, t, :1] == a[:, t]).any(axis=1)
            t = self.tab  # of two buckets of this table, the one of the lesser id's own code has it
            both = (a[:, t, :1] == b[:, t, 1:]).any(axis=1) & (b[:, t, :1] == a[:, t, 1:]).any(axis=1)
            met |= both & (self.rep[i] > self.rep[j])
            yield np.minimum(self.rep[i], self.rep[j])[~met], np.maximum(self.rep[i], self.rep[j])[~met]


def _verify(least: float, tables: int, dtype: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, part); only the buckets that are open are held."""
        held: list[pa.Table] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
                if e - s < 2 or not table.column("own").slice(s, e - s).to_numpy().any():
                    continue
                for a, b in _Bucket(table.slice(s, e - s), tables, dtype).pairs(least):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            table = pa.concat_tables(held)
            key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
            other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            yield from done(table.slice(0, cut)) if cut else ()
            held = [table.slice(cut)]
        if held:
            yield from done(pa.concat_tables(held))

    return of


def vector_links(classes: DataFrame, least: float = 0.98, tables: int = 6, seed: int = 11, split: int = 4096) -> DataFrame:
    """classes(rep bigint, grp bigint, embedding array<float|double>), distinct valid vectors, to links (a < b), once each."""
    given = classes.select("rep", "grp", "embedding")
    dtype = "<f4" if "float" in dict(given.dtypes)["embedding"] else "<f8"
    hot = written(
        given.mapInArrow(_hash_rows(tables, seed, True), "key bigint").groupBy("key").count().where(F.col("count") > split)
        .select(F.col("key").alias("hot"), F.ceil(F.col("count") / (split // 2)).cast("int").alias("parts"))
    )
    rows = given.mapInArrow(_hash_rows(tables, seed, False), ROWS)
    n = hot.count()
    if n:
        rows = rows.join(F.broadcast(hot) if n <= BROADCAST_HOT else hot, F.col("key") == F.col("hot"), "left").drop("hot")
        rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        rows = rows.withColumn("parts", F.lit(1))
    rows = (
        rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("part", F.least("salt", "with") * F.col("parts") + F.greatest("salt", "with"))
        .withColumn("cross", F.col("part") % (F.col("parts") + 1) != 0)
        .drop("with", "parts")
    )
    dealt = rows.repartition(input_tasks(classes.sparkSession), "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_verify(least, tables, dtype), "a bigint, b bigint")


def near_vectors(vectors: DataFrame, least: float = 0.98, **how) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label)."""
    number = "double" if "double" in dict(vectors.dtypes)["embedding"] else "float"
    x = F.col("embedding").cast(f"array<{number}>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    marked = vectors.select("vec_id", x.alias("embedding"), F.xxhash64("label").alias("grp"), F.coalesce(valid, F.lit(False)).alias("valid"))
    found = written(marked.where("valid").groupBy("grp", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    links = written(vector_links(found, least, **how))
    sizes = found.select(F.col("rep").alias("b"), "size")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(sizes, "b").groupBy(F.col("a").alias("node_a")).agg(F.sum("size").alias("others"))
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = written(
        found.join(degree, F.col("rep") == F.col("node_a"), "left")
        .join(comp, F.col("rep") == F.col("node"), "left")
        .select("grp", "embedding", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    told = marked.where("valid").drop("valid").join(classes, ["grp", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not valid").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )

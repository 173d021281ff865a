"""The k nearest other rows of every row in the plane, exactly, as joins on tiles.

Rows at one place are one place: whoever asks, only the k + 1 least ids of a place can be among the nearest, as ties go to the lesser id.
Places stand in Z-order and are cut into tiles of equal numbers. A place first searches its own tile, which bounds how far its neighbours
can be. The square of that radius is covered by at most four cells of the Z-order's quadtree; a cell is an interval of codes, so the tiles
that reach into it are found by bisection, and those whose box is within the radius are visited: a shuffle of (tile, place).

Scale: a tile has TILE places, or more where there would be more than MOST_TILES tiles, so the tiles' boxes (seven numbers each, at most MOST_TILES)
are what is broadcast. Rows of one place are combined before they are shuffled. Null and NaN coordinates and values are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.common import global_position, written

TILE = 1024
MOST_TILES = 1 << 18
#: Distances that are held at once.
_HELD = 1 << 21
_BITS = 31
#: The masks of the usual doubling of gaps between the bits of a 32-bit number.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))

NEAR = "array<struct<d:double,id:bigint,v:double>>"
_NEAR_ARROW = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("v", pa.float64())]))


def _spread_column(v: Column) -> Column:
    for by, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
    return v


def _spread(v: np.ndarray) -> np.ndarray:
    for by, mask in _SPREAD:
        v = (v | (v << by)) & mask
    return v


@dataclass
class Plane:
    """The Z-order's grid: 2^31 - 1 steps of each axis."""

    x0: float
    y0: float
    scale: tuple[float, float]
    tiles: int
    top: int = (1 << _BITS) - 1


def z_tiles(rows: DataFrame, size: int) -> tuple[DataFrame, Plane | None]:
    """rows(x, y, ...) with pos and code in Z-order and tile, written; tiles have at least ``size`` rows, unless there is only one."""
    rows = written(rows)
    told = rows.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not told.n:
        return rows, None
    plane = Plane(told.x0, told.y0, (0.0, 0.0), max(1, min(MOST_TILES, told.n // size)))
    plane.scale = tuple(plane.top / ((b - a) or 1.0) for a, b in ((told.x0, told.x1), (told.y0, told.y1)))
    whole = lambda c, low, by: F.least(F.lit(plane.top), F.floor((F.col(c) - low) * by)).cast("long")
    code = _spread_column(whole("x", plane.x0, plane.scale[0])).bitwiseOR(F.shiftleft(_spread_column(whole("y", plane.y0, plane.scale[1])), 1))
    placed = global_position(rows.withColumn("code", code), "code", "x", "y")
    return written(placed.withColumn("tile", F.expr(f"int((pos - 1) * {plane.tiles} div {told.n})"))), plane


def tile_boxes(placed: DataFrame) -> dict[str, np.ndarray]:
    """By tile the least and greatest code, x and y: code_0, code_1, and so on."""
    boxes = placed.groupBy("tile").agg(*[f(c).alias(f"{c}_{k}") for c in ("code", "x", "y") for k, f in ((0, F.min), (1, F.max))]).orderBy("tile").toPandas()
    return {c: boxes[c].to_numpy() for c in boxes.columns}


class _Members:
    """Places of a tile with the rows that they hold: ``ids`` and ``values`` from first[i] to first[i + 1]."""

    def __init__(self, table: pa.Table) -> None:
        column = lambda c: table.column(c).combine_chunks()
        self.x, self.y = column("x").to_numpy(), column("y").to_numpy()
        held = column("held")
        held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
        rows = held.flatten()
        self.size = held.value_lengths().to_numpy().astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.ids, self.values = rows.field("id").to_numpy(), rows.field("v").to_numpy(zero_copy_only=False)

    def best(self, x: np.ndarray, y: np.ndarray, k: int, within: np.ndarray | None = None) -> pa.Array:
        """The k rows with the least (distance, id) of each asked place, those at most ``within`` away."""
        out, chunk = [], max(1, _HELD // max(1, len(self.x)))
        for at in range(0, len(x), chunk):
            d = np.sqrt((x[at : at + chunk, None] - self.x) ** 2 + (y[at : at + chunk, None] - self.y) ** 2)
            limit = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
            if within is not None:
                limit = np.minimum(limit, within[at : at + chunk])
            asked, place = np.nonzero(d <= limit[:, None])
            size = self.size[place]
            row = np.repeat(self.first[place] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            asked, far = np.repeat(asked, size), np.repeat(d[asked, place], size)
            order = np.lexsort([self.ids[row], far, asked])
            asked, far, row = asked[order], far[order], row[order]
            start = np.searchsorted(asked, np.arange(len(d)))
            some = np.arange(len(asked)) - start[asked] < k
            asked, far, row = asked[some], far[some], row[some]
            ends = np.append(0, np.cumsum(np.bincount(asked, minlength=len(d)))).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(far), pa.array(self.ids[row]), pa.array(self.values[row])], names=["d", "id", "v"])
            out.append(pa.ListArray.from_arrays(pa.array(ends), rows))
        return pa.concat_arrays(out) if out else pa.array([], _NEAR_ARROW)


def k_nearest(points: DataFrame, k: int, x: str = "x", y: str = "y", value: str | None = None, places: bool = False) -> DataFrame:
    """points(row_id, x, y) to (row_id, near): up to k others as (d, id, v), by distance and then id; ``value`` gives v, which is null else.

    Ids are whole numbers. With ``places`` the result is (x, y, near) with the k + 1 nearest rows of each place, its own among them.
    """
    spark = points.sparkSession
    rows = points.select(F.col("row_id").cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(value) if value else F.lit(None)).cast("double").alias("v"))
    rows = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)" + (" and v is not null" if value else ""))
    first = Window.partitionBy("x", "y").orderBy("id")
    spots = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1).groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("held"))
    placed, plane = z_tiles(spots, max(TILE, k + 1))
    if not plane:
        return placed.select("x", "y", F.lit(None).cast(NEAR).alias("near")) if places else rows.select(F.col("id").alias("row_id"), F.lit(None).cast(NEAR).alias("near"))
    top, x0, y0, scale = plane.top, plane.x0, plane.y0, plane.scale

    def own(table: pa.Table) -> pa.Table:
        members = _Members(table)
        return pa.table([table.column("pos"), table.column("tile"), pa.chunked_array([pa.array(members.x)]), pa.chunked_array([pa.array(members.y)]), pa.chunked_array([members.best(members.x, members.y, k + 1)])], names=["pos", "tile", "x", "y", "near"])

    near = written(placed.groupBy("tile").applyInArrow(own, f"pos bigint, tile int, x double, y double, near {NEAR}"))
    if plane.tiles > 1:
        sent = spark.sparkContext.broadcast(tile_boxes(placed))

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            box = sent.value
            grid = lambda v, low, by: np.clip(np.floor((v - low) * by), 0, top).astype(np.int64)
            for batch in batches:
                pos, tile, px, py, r = (batch.column(i).to_numpy() for i in range(5))
                wide = r * (1 + 1e-9) + 1e-300
                a0, a1 = grid(px - wide, x0, scale[0]), grid(px + wide, x0, scale[0])
                b0, b1 = grid(py - wide, y0, scale[1]), grid(py + wide, y0, scale[1])
                span = np.maximum(a1 - a0, b1 - b0)
                level = np.where(span > 0, np.frexp(span.astype(np.float64))[1], 0).astype(np.int64)  # 2^level > span
                for i in (0, 1):
                    for j in (0, 1):
                        a, b = (a1 if i else a0) >> level, (b1 if j else b0) >> level
                        new = np.ones(len(a), bool)
                        if i:
                            new &= a != a0 >> level
                        if j:
                            new &= b != b0 >> level
                        low = (_spread(a) | (_spread(b) << 1)) << (2 * level)
                        t0 = np.searchsorted(box["code_1"], low, side="left")
                        t1 = np.searchsorted(box["code_0"], low + (np.int64(1) << (2 * level)) - 1, side="right")
                        many = np.where(new, np.maximum(t1 - t0, 0), 0)
                        upto, at = np.cumsum(many), 0
                        while at < len(many):
                            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _HELD, side="right")))
                            m = many[at:end]
                            who = np.repeat(np.arange(at, end), m)
                            t = np.repeat(t0[at:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                            dx = np.maximum(np.maximum(box["x_0"][t] - px[who], px[who] - box["x_1"][t]), 0)
                            dy = np.maximum(np.maximum(box["y_0"][t] - py[who], py[who] - box["y_1"][t]), 0)
                            some = (t != tile[who]) & (dx * dx + dy * dy <= wide[who] ** 2)
                            who, t = who[some], t[some]
                            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (pos[who], t.astype(np.int32), px[who], py[who], r[who])], names=["pos", "tile", "x", "y", "r"])
                            at = end

        kinds = "pos bigint, tile int, x double, y double, r double"
        # Cells of a place are disjoint, but a tile may reach into several.
        asked = near.select("pos", "tile", "x", "y", F.element_at("near", -1)["d"].alias("r")).mapInArrow(visits, kinds).distinct()

        def search(key, asking: pa.Table, members: pa.Table) -> pa.Table:
            got = [pa.array([], _NEAR_ARROW)]
            if asking.num_rows and members.num_rows:
                column = lambda c: asking.column(c).combine_chunks().to_numpy()
                got = [_Members(members).best(column("x"), column("y"), k + 1, column("r"))]
            return pa.table([asking.column("pos") if members.num_rows else asking.column("pos").slice(0, 0), pa.chunked_array(got)], names=["pos", "near"])

        more = asked.groupBy("tile").cogroup(placed.groupBy("tile")).applyInArrow(search, f"pos bigint, near {NEAR}")
        every = near.select("pos", "near").unionAll(more).groupBy("pos").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
        near = near.select("pos", "x", "y").join(every, "pos")
    found = near.select("x", "y", "near")
    if places:
        return found
    return rows.select("id", "x", "y").join(found, ["x", "y"]).select(F.col("id").alias("row_id"), F.slice(F.filter("near", lambda b: b["id"] != F.col("id")), 1, k).alias("near"))


def nearest_unlike(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """points(row_id, label, asks, x, y) to (row_id, d): the distance of every asking row to the nearest row of another label; no row without one.

    A place with two labels is at distance zero for all of its rows; other places have one label and search the tiles as in k_nearest, without those
    that hold no other label. A place whose own tile holds none gets its bound from the nearest tiles in Z-order that do. Labels are whole numbers.
    """
    spark = points.sparkSession
    rows = points.select("row_id", F.col("label").cast("long").alias("label"), "asks", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = written(rows.where("label is not null and x is not null and y is not null and not isnan(x) and not isnan(y)"))
    spots = rows.groupBy("x", "y").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bool_or("asks").alias("asks"))
    placed, plane = z_tiles(spots, TILE)
    if not plane:
        return rows.select("row_id", F.lit(None).cast("double").alias("d"))
    top, x0, y0, scale = plane.top, plane.x0, plane.y0, plane.scale

    def least(px: np.ndarray, py: np.ndarray, label: np.ndarray, held: pa.Table) -> np.ndarray:
        hx, hy, low, high = (held.column(c).to_numpy() for c in ("x", "y", "low", "high"))
        out, chunk = np.full(len(px), np.inf), max(1, _HELD // max(1, len(hx)))
        for at in range(0, len(px) if len(hx) else 0, chunk):
            part = slice(at, at + chunk)
            d = np.sqrt((px[part, None] - hx) ** 2 + (py[part, None] - hy) ** 2)
            d[(low == label[part, None]) & (high == label[part, None])] = np.inf
            out[part] = d.min(axis=1)
        return out

    def own(table: pa.Table) -> pa.Table:
        asking = table.filter(table.column("asks"))
        px, py, low, high = (asking.column(c).to_numpy() for c in ("x", "y", "low", "high"))
        d, pure = np.zeros(len(px)), low == high
        d[pure] = least(px[pure], py[pure], low[pure], table)
        return pa.table([asking.column(c) for c in ("pos", "tile", "x", "y", "low")] + [pa.chunked_array([pa.array(d)])], names=["pos", "tile", "x", "y", "label", "d"])

    kinds = "pos bigint, tile int, x double, y double, label bigint, d double"
    near = written(placed.groupBy("tile").applyInArrow(own, kinds))
    every = near.select("pos", "d")
    if plane.tiles > 1:
        labels = placed.groupBy("tile").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("tile").toPandas()
        box = tile_boxes(placed) | {c: labels[c].to_numpy() for c in ("low", "high")}
        # A run of tiles of the same single label; the tiles before and after it hold another.
        single = np.where(box["low"] == box["high"], box["low"], 0)
        new_run = np.append(True, (single[1:] != single[:-1]) | (box["low"] != box["high"])[1:] | (box["low"] != box["high"])[:-1])
        starts, run = np.flatnonzero(new_run), np.cumsum(new_run) - 1
        box |= {"before": starts[run] - 1, "after": np.append(starts[1:], len(run))[run]}
        sent = spark.sparkContext.broadcast(box)

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            box = sent.value
            tiles = len(box["low"])
            grid = lambda v, low, by: np.clip(np.floor((v - low) * by), 0, top).astype(np.int64)
            gap = lambda c, t, v: np.maximum(np.maximum(box[f"{c}_0"][t] - v, v - box[f"{c}_1"][t]), 0)
            span = lambda c, t, v: np.maximum(box[f"{c}_1"][t] - v, v - box[f"{c}_0"][t])
            for batch in batches:
                pos, tile, px, py, label, d = (batch.column(i).to_numpy() for i in range(6))
                r = d * (1 + 1e-9) + 1e-300
                for side in ("before", "after"):
                    t = box[side][tile]
                    some = np.isinf(d) & (t >= 0) & (t < tiles)
                    t = t[some]
                    r[some] = np.minimum(r[some], np.hypot(span("x", t, px[some]), span("y", t, py[some])) * (1 + 1e-9) + 1e-300)
                able = np.flatnonzero(np.isfinite(r) & (d > 0))
                pos, tile, px, py, label, r = (v[able] for v in (pos, tile, px, py, label, r))
                a0, a1 = grid(px - r, x0, scale[0]), grid(px + r, x0, scale[0])
                b0, b1 = grid(py - r, y0, scale[1]), grid(py + r, y0, scale[1])
                width = np.maximum(a1 - a0, b1 - b0)
                level = np.where(width > 0, np.frexp(width.astype(np.float64))[1], 0).astype(np.int64)  # 2^level > width
                t0, many = [], []
                for i in (0, 1):
                    for j in (0, 1):
                        a, b = (a1 if i else a0) >> level, (b1 if j else b0) >> level
                        new = np.ones(len(a), bool)
                        if i:
                            new &= a != a0 >> level
                        if j:
                            new &= b != b0 >> level
                        low = (_spread(a) | (_spread(b) << 1)) << (2 * level)
                        t0.append(np.searchsorted(box["code_1"], low, side="left"))
                        t1 = np.searchsorted(box["code_0"], low + (np.int64(1) << (2 * level)) - 1, side="right")
                        many.append(np.where(new, np.maximum(t1 - t0[-1], 0), 0))
                t0, many = np.stack(t0, axis=1), np.stack(many, axis=1)
                upto, at = np.cumsum(many.sum(axis=1)), 0
                while at < len(r):
                    end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _HELD, side="right")))
                    m = many[at:end].ravel()
                    who = np.repeat(np.repeat(np.arange(at, end), 4), m)
                    t = np.repeat(t0[at:end].ravel() - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    some = (t != tile[who]) & ((box["low"][t] != label[who]) | (box["high"][t] != label[who]))
                    who, t = who[some], t[some]
                    # The farthest corner of any tile bounds the distance, so most tiles of a wide radius are left out.
                    bound = r[at:end].copy()
                    np.minimum.at(bound, who - at, np.hypot(span("x", t, px[who]), span("y", t, py[who])) * (1 + 1e-9) + 1e-300)
                    some = np.hypot(gap("x", t, px[who]), gap("y", t, py[who])) <= bound[who - at]
                    pairs = np.unique(np.stack([who[some], t[some]], axis=1), axis=0)
                    who, t = pairs[:, 0], pairs[:, 1]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (pos[who], t.astype(np.int32), px[who], py[who], label[who], bound[who - at])], names=["pos", "tile", "x", "y", "label", "d"])
                    at = end

        def search(key, asking: pa.Table, held: pa.Table) -> pa.Table:
            d = least(*(asking.column(c).to_numpy() for c in ("x", "y", "label")), held)
            return pa.table([asking.column("pos"), pa.chunked_array([pa.array(d)])], names=["pos", "d"])

        more = near.mapInArrow(visits, kinds).groupBy("tile").cogroup(placed.groupBy("tile")).applyInArrow(search, "pos bigint, d double")
        every = every.unionAll(more)
    found = every.groupBy("pos").agg(F.min("d").alias("d")).where(F.col("d") < float("inf")).join(placed.select("pos", "x", "y"), "pos").drop("pos")
    return rows.where("asks").select("row_id", "x", "y").join(found, ["x", "y"]).select("row_id", "d")

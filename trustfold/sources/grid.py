"""Raster-like tables: one row a cell (col, row, bands...), with an origin and a cell size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    cells: DataFrame  # col bigint, row bigint, bands
    x0: float
    y0: float
    size: float

    def bands(self) -> list[str]:
        return [c for c in self.cells.columns if c not in ("col", "row")]


def read_grid(spark, path: str, x0: float, y0: float, size: float) -> Grid:
    return Grid(spark.read.parquet(path), x0, y0, size)


def extract(grid: Grid, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points with their cell's bands: an equi-join on computed cells. Points off the grid or with a null band are dropped."""
    at = points.withColumns({"col": F.floor((F.col(x) - grid.x0) / grid.size), "row": F.floor((F.col(y) - grid.y0) / grid.size)})
    return at.join(grid.cells, ["col", "row"]).dropna(subset=grid.bands()).drop("col", "row")


def cell_points(grid: Grid) -> DataFrame:
    """Cells as rows with centre coordinates and a row_id, for scoring and applicability."""
    key = F.xxhash64("col", "row").alias("row_id")
    return grid.cells.select(key, (grid.x0 + (F.col("col") + 0.5) * grid.size).alias("x"), (grid.y0 + (F.col("row") + 0.5) * grid.size).alias("y"), *grid.bands())


def predict_grid(grid: Grid, predict, train: DataFrame, predictors: list[str]) -> DataFrame:
    """Cells with prediction, dissimilarity and applicability."""
    from ..operators.applicability import area_of_applicability

    cells = cell_points(grid)
    return predict(cells).join(area_of_applicability(train, cells, predictors), "row_id")

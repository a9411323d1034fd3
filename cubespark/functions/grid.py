"""Affine raster grids: pixels, chunks and tiles as plain arithmetic on columns.

A grid is north-up: row 0 is the top, y falls as iy rises. Tiles and windows are half open, [low, high).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BBox = tuple[float, float, float, float]  # left, bottom, right, top


@dataclass(frozen=True)
class Window:
    """A range of pixels: ix in [ix0, ix1), iy in [iy0, iy1)."""

    ix0: int
    ix1: int
    iy0: int
    iy1: int

    @property
    def empty(self) -> bool:
        return self.ix0 >= self.ix1 or self.iy0 >= self.iy1

    def meet(self, other: Window) -> Window:
        return Window(max(self.ix0, other.ix0), min(self.ix1, other.ix1), max(self.iy0, other.iy0), min(self.iy1, other.iy1))

    def grow(self, pixels: int) -> Window:
        return Window(self.ix0 - pixels, self.ix1 + pixels, self.iy0 - pixels, self.iy1 + pixels)


@dataclass(frozen=True)
class GridSpec:
    x0: float
    y_top: float
    res: float
    nx: int
    ny: int
    epsg: int

    @classmethod
    def from_bbox(cls, bbox: BBox, res: float, epsg: int) -> GridSpec:
        """The smallest grid over a box whose edges are multiples of the resolution."""
        left, bottom, right, top = bbox
        c0, c1 = math.floor(left / res), math.ceil(right / res)
        r0, r1 = math.floor(bottom / res), math.ceil(top / res)
        return cls(c0 * res, r1 * res, res, c1 - c0, r1 - r0, epsg)

    @classmethod
    def from_shape(cls, bbox: BBox, nx: int, ny: int, epsg: int) -> GridSpec:
        """A grid of exactly this shape; the box must give square pixels."""
        left, bottom, right, top = bbox
        res = (right - left) / nx
        if abs((top - bottom) / ny - res) > 1e-9 * res:
            raise ValueError("pixels must be square; unequal resolutions are not supported")
        return cls(left, top, res, nx, ny, epsg)

    @property
    def bbox(self) -> BBox:
        return (self.x0, self.y_top - self.ny * self.res, self.x0 + self.nx * self.res, self.y_top)

    @property
    def window(self) -> Window:
        return Window(0, self.nx, 0, self.ny)

    def ring(self) -> list[tuple[float, float]]:
        left, bottom, right, top = self.bbox
        return [(left, bottom), (right, bottom), (right, top), (left, top)]

    def window_of(self, bbox: BBox) -> Window:
        """Pixels that a box touches, within the grid. A box that only meets an edge touches nothing."""
        left, bottom, right, top = bbox
        ix0, ix1 = math.floor((left - self.x0) / self.res), math.ceil((right - self.x0) / self.res)
        iy0, iy1 = math.floor((self.y_top - top) / self.res), math.ceil((self.y_top - bottom) / self.res)
        return self.window.meet(Window(ix0, ix1, iy0, iy1))

    def chunk_shape(self, chunk: int) -> tuple[int, int]:
        """Rows and columns of chunks."""
        return -(-self.ny // chunk), -(-self.nx // chunk)

    def overlap(self, other: GridSpec) -> tuple[Window, Window]:
        """The part that two grids of one resolution share, as a window of this grid and one of the other."""
        if self.epsg != other.epsg or abs(self.res - other.res) > 1e-9 * self.res:
            raise ValueError("grids differ in CRS or resolution")
        dx, dy = round((other.x0 - self.x0) / self.res), round((self.y_top - other.y_top) / self.res)
        mine = self.window.meet(Window(dx, dx + other.nx, dy, dy + other.ny))
        return mine, Window(mine.ix0 - dx, mine.ix1 - dx, mine.iy0 - dy, mine.iy1 - dy)

    def correct_bounds(self, other: GridSpec) -> GridSpec:
        """`other` without what overhangs this grid. ValueError if they are disjoint."""
        mine, theirs = self.overlap(other)
        if mine.empty:
            raise ValueError("the tile lies outside the cube")
        return GridSpec(other.x0 + theirs.ix0 * self.res, other.y_top - theirs.iy0 * self.res, self.res, theirs.ix1 - theirs.ix0, theirs.iy1 - theirs.iy0, self.epsg)

    # Column arithmetic

    def ix(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.res).cast("int")

    def iy(self, y: Column) -> Column:
        return F.floor((F.lit(self.y_top) - y) / self.res).cast("int")

    def x(self, ix: Column) -> Column:
        return F.lit(self.x0) + (ix + 0.5) * self.res

    def y(self, iy: Column) -> Column:
        return F.lit(self.y_top) - (iy + 0.5) * self.res

    def tiles(self, spark: SparkSession, chunk: int, window: Window | None = None) -> DataFrame:
        """Tiles (row, col and their box), all or those that a pixel window touches. Nothing is stored or collected."""
        rows, cols = self.chunk_shape(chunk)
        w = (window or self.window).meet(self.window)
        if w.empty:
            r0 = r1 = c0 = c1 = 0
        else:
            r0, r1, c0, c1 = w.iy0 // chunk, -(-w.iy1 // chunk), w.ix0 // chunk, -(-w.ix1 // chunk)
        width = c1 - c0
        ids = spark.range((r1 - r0) * width)
        grid = ids.select((F.floor(F.col("id") / max(1, width)) + r0).cast("int").alias("row"), (F.col("id") % max(1, width) + c0).cast("int").alias("col"))
        return grid.select("row", "col", *self.tile_box(F.col("row"), F.col("col"), chunk))

    def tile_box(self, row: Column, col: Column, chunk: int) -> list[Column]:
        side = chunk * self.res
        return [
            (F.lit(self.x0) + col * side).alias("x_min"),
            F.greatest(F.lit(self.y_top) - (row + 1) * side, F.lit(self.bbox[1])).alias("y_min"),
            F.least(F.lit(self.x0) + (col + 1) * side, F.lit(self.bbox[2])).alias("x_max"),
            (F.lit(self.y_top) - row * side).alias("y_max"),
        ]

    def __str__(self) -> str:
        unit, digits = ("°", 5) if self.epsg == 4326 else ("m", 2)
        return f"GridSpec({self.ny} x {self.nx} at {self.res:.{digits}f}{unit}, EPSG:{self.epsg})"


def chunk_of(index: Column, chunk: int) -> Column:
    return F.floor(index / chunk).cast("int")


def patch_id(row: Column, col: Column, step: Column | None = None) -> Column:
    """"row-col", or "step-row-col" in a cube with time."""
    return F.concat_ws("-", *([] if step is None else [step.cast("string")]), row.cast("string"), col.cast("string"))


def parse_patch_id(patch: Column) -> Column:
    """STRUCT<it, row, col> of an id; it is null in a cube without time. Other numbers of parts raise an error."""
    parts = F.split(patch, "-")
    n = F.size(parts)
    at = lambda i: F.try_element_at(parts, i).cast("int")
    fields = F.struct(F.when(n == 3, at(F.lit(-3))).alias("it"), at(F.lit(-2)).alias("row"), at(F.lit(-1)).alias("col"))
    return F.when(n.isin(2, 3), fields).otherwise(F.raise_error(F.concat(F.lit("not a patch id: "), patch)).cast("struct<it:int,row:int,col:int>"))


def resolution_label(res: Column) -> Column:
    return F.concat(res.cast("int").cast("string"), F.lit("m"))

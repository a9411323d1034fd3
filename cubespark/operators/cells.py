"""Operators on cells: one row a pixel (and step), one column a channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.grid import GridSpec, Window, chunk_of


def crop(cells: DataFrame, window: Window, chunk: int | None = None) -> DataFrame:
    """Cells in a pixel window; the polygon itself does not mask. With `chunk`, the bounds on chunk_x and chunk_y that
    follow are added, which Catalyst cannot derive, so that whole partitions are not read."""
    keep = F.col("ix").between(window.ix0, window.ix1 - 1) & F.col("iy").between(window.iy0, window.iy1 - 1)
    if chunk:
        keep = keep & F.col("chunk_x").between(window.ix0 // chunk, (window.ix1 - 1) // chunk)
        keep = keep & F.col("chunk_y").between(window.iy0 // chunk, (window.iy1 - 1) // chunk)
    return cells.filter(keep)


def inside(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Cells within a grid; what overhangs goes."""
    return crop(cells, grid.window)


def with_chunks(cells: DataFrame, chunk: int) -> DataFrame:
    return cells.withColumns({"chunk_y": chunk_of(F.col("iy"), chunk), "chunk_x": chunk_of(F.col("ix"), chunk)})


def with_coordinates(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Pixel centres."""
    return cells.withColumns({"x": grid.x(F.col("ix")), "y": grid.y(F.col("iy"))})


def flip_y(cells: DataFrame, ny: int) -> DataFrame:
    return cells.withColumn("iy", F.lit(ny - 1) - F.col("iy"))


def rename_axes(cells: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return cells.withColumnsRenamed({lon: "x", lat: "y"})


def shift_antimeridian(cells: DataFrame, tile_left: Column, x: str = "x") -> DataFrame:
    return cells.withColumn(x, crs.unwrap(F.col(x), tile_left))


def expand_time(cells: DataFrame, axis: DataFrame) -> DataFrame:
    """Each cell at each step; the axis is small by construction."""
    return cells.crossJoin(F.broadcast(axis))


def value(c: Column) -> Column:
    """A channel's value with NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def window_stats(cells: DataFrame, channels: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, least and largest value of each channel, one row (or group) wide."""
    aggs = [f(value(F.col(c).cast("double"))).alias(f"{c}_{name}") for c in channels for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return (cells.groupBy(*by) if by else cells).agg(*aggs)


def long_stats(cells: DataFrame, channels: list[str]) -> DataFrame:
    """Mean, least and largest value of each channel, a row a channel: channel, mean, min, max.

    Channels become rows first: three aggregates over rows stay in generated code, three for each of many columns do not.
    """
    values = cells.select(F.posexplode(F.array(*[value(F.col(c).cast("double")) for c in channels])).alias("_c", "_v"))
    found = values.groupBy("_c").agg(F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    names = cells.sparkSession.createDataFrame(list(enumerate(channels)), "_c int, channel string")
    return F.broadcast(found).join(names, "_c", "right").select("channel", "mean", "min", "max")  # a row a channel on both sides


def any_nan(cells: DataFrame, channels: list[str], by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(*[F.bool_or(F.isnan(c)).alias(f"{c}_nan") for c in channels])


def axis_extent(cells: DataFrame, column: str, resolution: float) -> DataFrame:
    """First and last coordinate and the resolution of an axis."""
    return cells.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.lit(float(resolution)).alias("resolution"))


def clip_cast(c: Column, low: Column, high: Column) -> Column:
    """Clip, then cast towards zero to a whole number of one byte, kept as SMALLINT: Spark has no unsigned byte."""
    return F.greatest(low, F.least(c, high)).cast("smallint")


def densify(cells: DataFrame, window: Window, channels: list[str], fill: float = 0, groups: DataFrame | None = None) -> DataFrame:
    """Every pixel of a window, in each row of `groups` (time steps, say), with its columns; pixels never written have the
    fill value, also in groups without cells.

    Only the window is made dense, from a range that is joined by pixel.
    """
    spark, width = cells.sparkSession, max(0, window.ix1 - window.ix0)
    n = width * max(0, window.iy1 - window.iy0)
    full = spark.range(n).select((F.col("id") % max(1, width) + window.ix0).cast("int").alias("ix"), (F.floor(F.col("id") / max(1, width)) + window.iy0).cast("int").alias("iy"))
    keys = ["ix", "iy"]
    if groups is not None:
        full, keys = full.crossJoin(groups), [*keys, *groups.columns]
    held = crop(cells, window).select(*keys, *channels)

    def filled(c: str) -> Column:
        kind = held.schema[c].dataType
        own = value(F.col(c)) if kind.typeName() in ("float", "double") else F.col(c)
        return F.coalesce(own, F.lit(fill).cast(kind)).alias(c)

    return full.join(held, keys, "left").select(*keys, *map(filled, channels))

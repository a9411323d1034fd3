"""Mosaics, the overlay of patches on a cube, and gap filling. A missing value is NaN or null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import checkpoint
from .cells import clip_cast, value

PIXEL = ["ix", "iy"]


def mosaic_max(cells: DataFrame, channels: list[str], by: list[str] | None = None) -> DataFrame:
    """Largest value of each pixel over time; missing values are skipped."""
    return cells.groupBy(*(by or PIXEL)).agg(*[F.max(value(F.col(c)) if _floats(cells, c) else F.col(c)).alias(c) for c in channels])


def mosaic_last(cells: DataFrame, channels: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """The value on top of each pixel: the last valid one in the order of these columns."""
    on_top = F.struct(*order)
    aggs = []
    for c in channels:
        valid = value(F.col(c)) if _floats(cells, c) else F.col(c)
        aggs.append(F.max(F.when(valid.isNotNull(), F.struct(on_top.alias("o"), valid.alias("v"))))["v"].alias(c))
    return cells.groupBy(*(by or PIXEL)).agg(*aggs)


def _floats(cells: DataFrame, c: str) -> bool:
    return cells.schema[c].dataType.typeName() in ("float", "double")


def overlay(cube: DataFrame, patch: DataFrame, channels: list[str], by: list[str] | None = None) -> DataFrame:
    """Put a patch on a cube: its valid cells win, its missing ones leave what the cube has."""
    keys = by or PIXEL
    new = patch.select(*keys, *[F.col(c).alias(f"_{c}") for c in channels])
    pick = lambda c: (F.coalesce(value(F.col(f"_{c}")), F.col(c)) if _floats(patch, c) else F.coalesce(f"_{c}", c)).alias(c)
    return cube.select(*keys, *channels).join(new, keys, "full_outer").select(*keys, *map(pick, channels))


def band_range(cells: DataFrame, channels: list[str]) -> DataFrame:
    """Least and largest valid value of each channel: one row."""
    return cells.agg(*[f(value(F.col(c))).alias(f"{c}_{n}") for c in channels for n, f in (("min", F.min), ("max", F.max))])


def fill_gaps(cells: DataFrame, channel: str, by: list[str]) -> DataFrame:
    """Give each missing pixel the value of the nearest valid one of its patch (`by`).

    Distances are Euclidean; of equally near pixels the one with the smaller (iy, ix) counts. A nearest pixel lacks a valid
    neighbour on the side of the gap, which would be nearer; so only such border pixels are looked at. Search rings grow: the gaps
    that are left look for valid pixels in square bins of the ring's radius, their own and the eight around, so each round
    is an equi join and no patch is gathered in one place. A value found at distance r is final once r is at most the
    radius. The loop ends when all gaps are filled, or with the ring that covers the whole patch.
    """
    keys = [*by, *PIXEL]
    cells = cells.withColumn("_v", value(F.col(channel).cast("double")))
    valid, gaps = _border(cells.filter("_v IS NOT NULL").select(*keys, "_v"), by), cells.filter("_v IS NULL").select(*keys)
    span = cells.agg(F.max("ix") - F.min("ix"), F.max("iy") - F.min("iy")).first()
    reach = 1 + max(span[0] or 0, span[1] or 0)
    done, left, radius = None, gaps, 2
    while True:
        binned = valid.withColumns({"_bx": F.floor(F.col("ix") / radius), "_by": F.floor(F.col("iy") / radius)})
        around = F.array(*[F.lit(-1), F.lit(0), F.lit(1)])
        asked = left.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
        asked = asked.select(*by, F.col("ix").alias("gx"), F.col("iy").alias("gy"), (F.floor(F.col("ix") / radius) + F.col("_dx")).alias("_bx"), (F.floor(F.col("iy") / radius) + F.col("_dy")).alias("_by"))
        met = asked.join(binned, [*by, "_bx", "_by"])
        apart = lambda a, b: F.col(a).cast("long") - F.col(b)
        d2 = apart("ix", "gx") * apart("ix", "gx") + apart("iy", "gy") * apart("iy", "gy")
        last = radius >= reach
        near = met.withColumn("_d2", d2).filter(F.lit(True) if last else F.col("_d2") <= radius * radius)
        best = near.groupBy(*by, "gx", "gy").agg(F.min(F.struct("_d2", "iy", "ix", "_v")).alias("_b"))
        found = checkpoint(best.select(*by, F.col("gx").alias("ix"), F.col("gy").alias("iy"), F.col("_b._v").alias("_v")))
        done = found if done is None else done.unionByName(found)
        if last:
            break
        left = checkpoint(left.join(found, keys, "left_anti"))
        if left.isEmpty():
            break
        radius *= 4
    filled = done.withColumnRenamed("_v", "_f")
    return cells.join(filled, keys, "left").select(*keys, F.coalesce("_v", "_f").alias(channel))


def _border(valid: DataFrame, by: list[str]) -> DataFrame:
    """The pixels that lack one of their four neighbours."""
    lacks = F.lit(False)
    for along, across in (("ix", "iy"), ("iy", "ix")):
        line = Window.partitionBy(*by, across).orderBy(along)
        beside = (F.lag(along).over(line) == F.col(along) - 1) & (F.lead(along).over(line) == F.col(along) + 1)
        lacks = lacks | ~F.coalesce(beside, F.lit(False))
    return valid.withColumn("_lacks", lacks).filter("_lacks").drop("_lacks")


def to_byte_bands(cells: DataFrame, channels: list[str], by: list[str]) -> DataFrame:
    """Per band: take the range, fill gaps, clip to the range from before, cast to a byte."""
    limits = F.broadcast(band_range(cells, channels))  # one row
    out = None
    for c in channels:
        one = fill_gaps(cells, c, by)
        out = one if out is None else out.join(one, [*by, *PIXEL])
    clipped = [clip_cast(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max")).alias(c) for c in channels]
    return out.crossJoin(limits).select(*by, *PIXEL, *clipped)

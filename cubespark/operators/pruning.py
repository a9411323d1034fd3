"""Which patches a request needs: spatial, time and manifest joins, all as equi joins on bins where they are range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom


def meet(a: str, b: str) -> Column:
    """Whether the boxes of two sides meet with their interiors."""
    names = ("x_min", "y_min", "x_max", "y_max")
    return geom.boxes_meet({n: F.col(f"{a}.{n}") for n in names}, {n: F.col(f"{b}.{n}") for n in names})


def _binned(boxes: DataFrame, box: str, size: float) -> DataFrame:
    """A row for each bin that a box meets. Columns of bins first, then the rows of each, so no row holds all of them."""
    lo = lambda c: F.floor(F.col(f"{box}.{c}") / size)
    columns = boxes.withColumn("bx", F.explode(F.sequence(lo("x_min"), lo("x_max"))))
    return columns.withColumn("by", F.explode(F.sequence(lo("y_min"), lo("y_max"))))


def spatial_join(tiles: DataFrame, areas: DataFrame, size: float, tile_ring: str | None = None, area_ring: str | None = None, area_parts: str | None = None) -> DataFrame:
    """Pairs of a tile and an area whose boxes meet, and whose convex rings do if given.

    Both sides have x_min, y_min, x_max, y_max, and are put into square bins of `size`, best about a tile's edge. The join
    is on the bin; a pair is taken only in the bin of the lower left corner of what they share, so it comes once.
    `area_parts`: instead of a ring, the area's convex parts, for areas of any form.
    """
    t = _binned(tiles.select(F.struct("*").alias("t")), "t", size)
    a = _binned(areas.select(F.struct("*").alias("a")), "a", size)
    first = (F.floor(F.greatest("t.x_min", "a.x_min") / size) == F.col("bx")) & (F.floor(F.greatest("t.y_min", "a.y_min") / size) == F.col("by"))
    pairs = t.join(a, ["bx", "by"]).filter(first & meet("t", "a"))
    if tile_ring and area_ring:
        pairs = pairs.filter(geom.convex_meet(F.col(f"t.{tile_ring}"), F.col(f"a.{area_ring}")))
    if tile_ring and area_parts:
        pairs = pairs.filter(F.exists(F.col(f"a.{area_parts}"), lambda p: geom.convex_meet(F.col(f"t.{tile_ring}"), p)))
    return pairs.select("t", "a")


def tiles_for_areas(tiles: DataFrame, areas: DataFrame, size: float, key: list[str], **rings: str) -> DataFrame:
    """Tiles that any area needs, each once."""
    return spatial_join(tiles, areas, size, **rings).select("t.*").dropDuplicates(key)


def tiles_for_box(tiles: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    left, bottom, right, top = box
    return tiles.filter((F.col("x_min") < right) & (F.col("x_max") > left) & (F.col("y_min") < top) & (F.col("y_max") > bottom))


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def missing(patches: DataFrame, manifest: DataFrame, key: str = "patch_id") -> DataFrame:
    """Patches that are not in the manifest; repeated ones stay repeated."""
    return patches.join(manifest.select(key).distinct(), key, "left_anti")


def by_ids(items: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return items.join(ids.select(key), key, "left_semi")


def patch_steps(tiles: DataFrame, axis: DataFrame) -> DataFrame:
    """Each tile at each requested step. The axis is small by construction."""
    return tiles.crossJoin(F.broadcast(axis))


def at_time(items: DataFrame, low: Column, high: Column, start: str = "t0", end: str = "t1") -> DataFrame:
    """Items whose time, an instant or an interval, meets [low, high]."""
    return items.filter((F.col(start) <= high) & (F.col(end) >= low))


def instant_or_range(items: DataFrame, instant: str, start: str, end: str) -> DataFrame:
    """t0 and t1 of items that have either an instant or a start and an end."""
    return items.withColumns({"t0": F.coalesce(instant, start), "t1": F.coalesce(instant, end)})


def _seconds(df: DataFrame, column: str, at: str | None = None) -> Column:
    """Whole seconds of a time; of one without a zone, and of a date, by its own clock, so that the order stays in any session."""
    if df.schema[column].dataType.typeName() == "timestamp":
        return F.unix_seconds(at or column)
    since = F.col(at or column).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return since.cast("interval second").cast("long")


#: Requests of one interval that make a full row of an interval join, and the parts into which it deals an interval's requests and a bin's items.
TOGETHER, DEALT = 1024, 8


def interval_join(items: DataFrame, requests: DataFrame, days: float | None = None) -> DataFrame:
    """Pairs (i, r) whose closed intervals [t0, t1] meet, joined on bins of so many days.

    By default a bin is as wide as the intervals are long on average (of the side with the longer ones), so that bins at most
    double a side and hold few pairs that do not meet. Requests of the same interval, up to TOGETHER * DEALT of them, are
    compared as one row, and become pairs after that. A bin's items are dealt to DEALT tasks, each with all of its requests.
    """
    items, requests = items.filter("t0 <= t1"), requests.filter("t0 <= t1")
    if days is None:
        lengths = [df.agg(F.avg(_seconds(df, "t1") - _seconds(df, "t0"))).first()[0] or 0.0 for df in (items, requests)]
        days = max(*lengths, 1.0) / 86400
    kinds = {"i": items, "r": requests}
    number = lambda c: F.floor(_seconds(kinds[c[0]], c[2:], c) / (days * 86400))
    bins = lambda s: F.explode(F.sequence(number(f"{s}.t0"), number(f"{s}.t1")))
    hashed = lambda df, at: [at + c for c, kind in df.dtypes if "map<" not in kind]
    i = items.select(F.struct("*").alias("i")).select("i", F.pmod(F.xxhash64(*hashed(items, "i.")), F.lit(DEALT)).alias("s"), bins("i").alias("b"))
    same = ["t0", "t1", "part"]
    r = requests.select("t0", "t1", F.struct("*").alias("r")).withColumn("part", F.pmod(F.xxhash64(*hashed(requests, "r.")), F.lit(DEALT)))
    r = r.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))) - 1) / TOGETHER))
    r = r.groupBy(*same, "block").agg(F.collect_list("r").alias("rs"))
    full = F.when(F.size("rs") == TOGETHER, F.struct("part", "block"))  # what is left of the parts is one row
    r = r.groupBy("t0", "t1", full.alias("full")).agg(F.flatten(F.collect_list("rs")).alias("rs"))
    r = r.select(F.struct("t0", "t1", "rs").alias("r")).withColumn("b", bins("r"))
    r = r.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    # The join makes many rows of few: as many tasks as the session has, however few bytes there are.
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    i, r = (df.repartition(n, "b", "s") for df in (i, r))
    meets = (F.col("i.t0") <= F.col("r.t1")) & (F.col("r.t0") <= F.col("i.t1"))
    first = F.col("b") == F.greatest(number("i.t0"), number("r.t0"))
    return i.join(r, ["b", "s"]).filter(first & meets).select("i", F.explode("r.rs").alias("r"))


def overlap_window(a: Column, b: Column) -> Column:
    """The pixel window that two windows STRUCT<ix0, ix1, iy0, iy1> share; null if they share nothing."""
    low, high = {k: F.greatest(a[k], b[k]) for k in ("ix0", "iy0")}, {k: F.least(a[k], b[k]) for k in ("ix1", "iy1")}
    some = (low["ix0"] < high["ix1"]) & (low["iy0"] < high["iy1"])
    return F.when(some, F.struct(low["ix0"].alias("ix0"), high["ix1"].alias("ix1"), low["iy0"].alias("iy0"), high["iy1"].alias("iy1")))

"""Sources whose patches come from a table of items: STAC JSON, Parquet indexes, or any table with these columns."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable
from functools import lru_cache
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom, toi
from ..operators.pruning import at_time, by_ids, instant_or_range
from .base import Fetch, Source, fetched, overlap_filter

if TYPE_CHECKING:
    from ..plans.cube import Area, Areas, Cube

#: The coordinates stay text until the type says how deep they are.
FEATURE = "struct<id:string,collection:string,geometry:struct<type:string,coordinates:string>,properties:struct<datetime:string,start_datetime:string,end_datetime:string>,assets:map<string,struct<href:string>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Items of GeoJSON feature collections: id, collection, geometry, rings, datetime, start_datetime, end_datetime, item.

    `rings` has all rings of a Polygon or MultiPolygon, `geometry` the convex hull's stand-in for searches: the ring itself
    if it is the only one, else the box of all.
    """
    files = spark.read.schema(f"type string, features array<{FEATURE}>").json(path, multiLine=True)
    return items_of(files.select(F.explode("features").alias("f")))


def parse_features(df: DataFrame, column: str) -> DataFrame:
    """The same from a column of JSON features."""
    return items_of(df.select(F.from_json(column, FEATURE).alias("f")))


def items_of(features: DataFrame) -> DataFrame:
    text, polygon = F.col("f.geometry.coordinates"), "array<array<array<double>>>"
    several = F.flatten(F.from_json(text, f"array<{polygon}>"))
    read = F.when(F.col("f.geometry.type") == "MultiPolygon", several).otherwise(F.from_json(text, polygon))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    opened = lambda r: F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), point)  # noqa: E731  GeoJSON repeats the first point
    rings = F.transform(read, opened)
    hull = geom.box(F.flatten(rings))
    whole = geom.box_ring(*[hull[c] for c in ("x_min", "y_min", "x_max", "y_max")])
    time = lambda c: F.to_timestamp(F.col(f"f.properties.{c}")).cast("timestamp_ntz").alias(c)
    return features.select(
        F.col("f.id").alias("id"),
        F.col("f.collection").alias("collection"),
        F.when(F.size(rings) == 1, F.element_at(rings, 1)).otherwise(whole).alias("geometry"),
        rings.alias("rings"),
        time("datetime"),
        time("start_datetime"),
        time("end_datetime"),
        F.transform_values("f.assets", lambda _, v: v["href"]).alias("item"),
    )


def as_patches(items: DataFrame) -> DataFrame:
    """Items as patches: an instant or a start and end become t_start and t_end, boxes come from the geometry."""
    timed = instant_or_range(items, "datetime", "start_datetime", "end_datetime")
    return timed.select(F.col("id").alias("patch_id"), F.col("id").alias("patch_order"), *[c.alias(n) for n, c in geom.box(F.col("geometry")).items()], "geometry", F.col("t0").alias("t_start"), F.col("t1").alias("t_end"), "item")


class ItemSource(Source):
    """Items of one collection in EPSG:4326, filtered by polygon and, for cubes with time, by time."""

    def __init__(self, items: DataFrame, fetch: Fetch, collection: str | None = None):
        self.items, self.fetch, self.collection = items, fetch, collection

    def search(self, area: Area | Areas | None = None, when: toi.Toi = None, ids: DataFrame | None = None) -> DataFrame:
        found = self.items if self.collection is None else self.items.filter(F.col("collection") == self.collection)
        if ids is not None:
            found = by_ids(found, ids, "id")
        out = as_patches(found)
        span = toi.time_range(when)
        if span is not None:
            low, high = span if isinstance(span, tuple) else (span, span)
            out = at_time(out, F.lit(low.to_pydatetime()).cast("timestamp_ntz"), F.lit(high.to_pydatetime()).cast("timestamp_ntz"), "t_start", "t_end")
        return out if area is None else overlap_filter(out, area)

    def patches(self, cube: Cube, aoi, steps: pd.DatetimeIndex | None, when: toi.Toi) -> DataFrame:
        from ..plans.cube import as_area

        return self.search(as_area(aoi).to(4326), when if cube.is_temporal else None)

    def cells(self, cube: Cube, patches: DataFrame) -> DataFrame:
        return fetched(patches.drop("geometry", "patch_order"), self.fetch, cube.definition.cell_schema(), log=cube.log)

    def state(self, cube: Cube, manifest: DataFrame) -> DataFrame:
        ids = manifest.select(F.col("patch_id").alias("id"))
        return self.search(ids=ids).select("geometry", F.col("patch_id").alias("id"), "t_start", "t_end", F.lit(4326).alias("epsg"))


class TableSource(ItemSource):
    """Items whose cells are in a table with patch_id, it, iy, ix and channels: nothing is fetched by Python."""

    def __init__(self, items: DataFrame, cells: DataFrame, collection: str | None = None):
        super().__init__(items, lambda row: None, collection)
        self.table = cells

    def cells(self, cube: Cube, patches: DataFrame) -> DataFrame:
        return by_ids(self.table, patches, "patch_id").select("patch_id", *cube.definition.cell_schema().names)


def item_url(base: str, item: Column, res: Column, collection: str) -> Column:
    """Where the item of an index entry lies: <base>/<collection>-<res>m/items/<item>."""
    return F.concat(F.lit(f"{base.rstrip('/')}/{collection}-"), res.cast("int").cast("string"), F.lit("m/items/"), item)


class IndexSource(Source):
    """Patches from a Parquet index (id, x_min, y_min, x_max, y_max, geometry) in the cube's CRS, not searched remotely.

    In a polar system a patch at the antimeridian is one piece, so tests there need no special case. Times are ignored.
    Only ids and URLs travel; `fetch` reads the item itself, once a worker. `ensure` makes the index if it is missing.
    """

    epsg = None

    def __init__(self, index_path: str, fetch: Fetch, url: Callable[[Column], Column], ensure: Callable[[], None] | None = None):
        self.index_path, self.fetch, self.url, self.ensure, self._index = index_path, fetch, url, ensure, None

    def index(self, spark: SparkSession) -> DataFrame:
        if self._index is None:
            if self.ensure is not None:
                self.ensure()
            self._index = spark.read.parquet(self.index_path)
        return self._index

    def patches(self, cube: Cube, aoi, steps: pd.DatetimeIndex | None, when: toi.Toi) -> DataFrame:
        from ..plans.cube import as_area

        cube.store.assert_created()
        area = as_area(aoi).to(cube.definition.grid.epsg)
        none = F.lit(None).cast("timestamp_ntz")
        found = overlap_filter(self.index(cube.spark).withColumn("patch_id", F.col("id")), area)
        return found.select(F.col("id").alias("patch_id"), F.col("id").alias("patch_order"), "x_min", "y_min", "x_max", "y_max", "geometry", none.alias("t_start"), none.alias("t_end"), F.create_map(F.lit("url"), self.url(F.col("id"))).alias("item"))

    cells = ItemSource.cells

    def state(self, cube: Cube, manifest: DataFrame) -> DataFrame:
        ids = manifest.select(F.col("patch_id").alias("id"))
        return by_ids(self.index(cube.spark), ids, "id").select("geometry", "id", F.lit(cube.definition.grid.epsg).alias("epsg"))


def aux_dir(default: str, variable: str = "CUBESPARK_AUX") -> str:
    """Where indexes are kept: the environment variable's folder or a default."""
    return os.environ.get(variable, default)


def unpack(archive: str, target: str, suffix: str = ".parquet") -> list[str]:
    """Extract the files of one kind from a zip archive into one flat folder. Files that are there stay as they are."""
    os.makedirs(target, exist_ok=True)
    out = []
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if name.endswith(suffix):
                path = os.path.join(target, os.path.basename(name))
                if not os.path.exists(path):
                    with z.open(name) as source, open(path, "wb") as sink:
                        sink.write(source.read())
                out.append(path)
    return out


def remembered(read: Callable[[str], object]) -> Callable[[str], object]:
    """An item reader that fetches each URL once a worker process."""
    return lru_cache(maxsize=256)(read)

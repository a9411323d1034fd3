"""Sources of patches: which there are for an area and time, and their cells.

A patches table has patch_id, patch_order, x_min, y_min, x_max, y_max (in `epsg`), geometry (a ring), t_start, t_end and item
(MAP<STRING, STRING>), and for cubes on a tile grid it, row and col. A cells table has patch_id, it, iy, ix and channels.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
from pyspark import Accumulator, AccumulatorParam
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geom, toi
from ..functions.grid import parse_patch_id, patch_id
from ..operators.pruning import patch_steps, tiles_for_areas

if TYPE_CHECKING:
    from ..plans.cube import Area, Areas, Cube

#: Gets a patch row as a dict; returns a table with it, iy, ix and the channels.
Fetch = Callable[[dict], pa.Table]
TRIES = 5


class SourceError(Exception):
    pass


class Source:
    """Subclasses say which patches there are and how their cells come about."""

    #: CRS of the patches' boxes; None: that of the cube.
    epsg: int | None = 4326

    def patches(self, cube: Cube, aoi, steps: pd.DatetimeIndex | None, when: toi.Toi) -> DataFrame:
        raise NotImplementedError

    def cells(self, cube: Cube, patches: DataFrame) -> DataFrame:
        raise NotImplementedError

    def state(self, cube: Cube, manifest: DataFrame) -> DataFrame:
        raise NotImplementedError


EVENT = "action STRING, patch_id STRING, time TIMESTAMP, thread_id BIGINT, thread_name STRING"


class Events(AccumulatorParam):
    """A list of events that tasks add to; a task that runs again adds its own."""

    def zero(self, value: list) -> list:
        return []

    def addInPlace(self, value1: list, value2: list) -> list:
        value1.extend(value2)
        return value1


def fetched(patches: DataFrame, fetch: Fetch, schema: T.StructType, tries: int = TRIES, pause: float = 0.0, log: Accumulator | None = None) -> DataFrame:
    """The cells of patches by a Python function, one task a patch. A failing fetch is tried again, `tries` times in all.

    `log`, an accumulator of Events, gets start_ and end_ of each try of each download: some rows a patch of the request.
    """
    names = patches.columns
    out = T.StructType([T.StructField("patch_id", T.StringType()), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark.sql.pandas.types import to_arrow_schema

        target, who = to_arrow_schema(out), f"worker-{os.getpid()}"

        def note(action: str, patch: str) -> None:
            if log is not None:
                log.add([(action, patch, datetime.now(timezone.utc), os.getpid(), who)])

        for batch in batches:
            for row in batch.to_pylist():
                for i in range(tries):
                    note(f"start_download_try{i}", row["patch_id"])
                    try:
                        table = fetch(row)
                        note(f"end_download_try{i}", row["patch_id"])
                        break
                    except Exception as e:  # KeyboardInterrupt and SystemExit pass
                        if i + 1 == tries:
                            raise SourceError(f"patch {row['patch_id']}: no success in {tries} tries") from e
                        time.sleep(pause)
                table = table.append_column("patch_id", pa.array([row["patch_id"]] * table.num_rows, pa.string()))
                yield from table.select(target.names).cast(target).to_batches()

    n = max(1, patches.count())
    return patches.select(names).repartition(n, "patch_id").mapInArrow(run, out)


def overlap_filter(patches: DataFrame, area: Area | Areas) -> DataFrame:
    """Patches (convex rings in the area's CRS) that meet the area: by box first, which the scan can use, then by form.

    With a table of areas that is a join on bins, as wide as the widest patch; each patch comes once.
    """
    from ..plans.cube import Areas

    if not isinstance(area, Areas):
        left, bottom, right, top = area.bbox
        boxes = (F.col("x_min") < right) & (F.col("x_max") > left) & (F.col("y_min") < top) & (F.col("y_max") > bottom)
        return patches.filter(boxes).filter(geom.any_meets(area.parts, F.col("geometry")))
    size = patches.agg(F.max(F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")))).first()[0]
    if not size:
        return patches.limit(0)
    return tiles_for_areas(patches, area.boxed(), size, ["patch_id"], tile_ring="geometry", area_parts="parts")


class TileSource(Source):
    """Patches are the tiles of the cube's own grid, at each requested step in a cube with time. Nothing is looked up.

    `fetch` gets patch_id, it, row, col, the tile's box and time. Patches share no cells.
    """

    epsg = None

    def __init__(self, fetch: Fetch):
        self.fetch = fetch

    def patches(self, cube: Cube, aoi, steps: pd.DatetimeIndex | None, when: toi.Toi) -> DataFrame:
        from ..plans.cube import as_area

        d = cube.definition
        tiles = d.grid.tiles(cube.spark, d.chunk, cube.window(aoi))
        tiles = tiles.withColumn("geometry", geom.box_ring(*[F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")]))
        tiles = overlap_filter(tiles.withColumn("patch_id", patch_id(F.col("row"), F.col("col"))), as_area(aoi).to(d.grid.epsg))
        step: Column | None = None
        if steps is not None:
            positions = d.axis.get_indexer(steps)
            axis = cube.spark.createDataFrame([(int(i), t.to_pydatetime()) for i, t in zip(positions, steps, strict=True)], "it int, t_start timestamp_ntz")
            tiles, step = patch_steps(tiles, axis), F.col("it")
        else:
            tiles = tiles.withColumns({"it": F.lit(None).cast("int"), "t_start": F.lit(None).cast("timestamp_ntz")})
        return tiles.withColumns(
            {
                "patch_id": patch_id(F.col("row"), F.col("col"), step),
                "t_end": F.col("t_start"),
                "item": F.create_map().cast("map<string,string>"),
                "patch_order": F.struct("it", "row", "col"),  # time first
            }
        )

    def cells(self, cube: Cube, patches: DataFrame) -> DataFrame:
        return fetched(patches.drop("geometry", "item", "patch_order"), self.fetch, cube.definition.cell_schema(), log=cube.log)

    def state(self, cube: Cube, manifest: DataFrame) -> DataFrame:
        d = cube.definition
        at = manifest.select(F.col("patch_id").alias("id"), parse_patch_id(F.col("patch_id")).alias("p"))
        boxed = at.select("id", "p.it", *d.grid.tile_box(F.col("p.row"), F.col("p.col"), d.chunk))
        out = boxed.withColumn("geometry", geom.box_ring(*[F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")]))
        if d.is_temporal:
            out = out.join(F.broadcast(toi.axis_table(cube.spark, d.axis)), "it").withColumnRenamed("t", "time")
        return out.select("geometry", "id", *["time"] * d.is_temporal, F.lit(d.grid.epsg).alias("epsg"))

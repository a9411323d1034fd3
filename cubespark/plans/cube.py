"""Cubes: load an area and time, ingest what is missing, tell what is there."""

from __future__ import annotations

import logging
import threading
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, geom, toi
from ..functions.grid import BBox, GridSpec
from ..functions.grid import Window as Pixels
from ..operators import cells as ops
from ..operators.pruning import missing
from ..sources.base import EVENT, Events, Source
from .definitions import CubeDef
from .store import NotCreatedError, Store


logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class Area:
    """A polygon as a ring of points in some CRS, with holes or further polygons as more rings (by the even-odd rule)."""

    ring: tuple[tuple[float, float], ...]
    epsg: int = 4326
    more: tuple[tuple[tuple[float, float], ...], ...] = ()

    @classmethod
    def box(cls, bbox: BBox, epsg: int = 4326) -> Area:
        left, bottom, right, top = bbox
        return cls(((left, bottom), (right, bottom), (right, top), (left, top)), epsg)

    @classmethod
    def geojson(cls, geometry: dict, epsg: int = 4326) -> Area:
        """A GeoJSON Polygon or MultiPolygon."""
        polygons = {"Polygon": lambda c: [c], "MultiPolygon": list}[geometry["type"]](geometry["coordinates"])
        rings = [tuple((float(p[0]), float(p[1])) for p in ring[:-1]) for polygon in polygons for ring in polygon]
        return cls(rings[0], epsg, tuple(rings[1:]))

    @classmethod
    def of(cls, aoi: Area | GridSpec | BBox | dict) -> Area:
        if isinstance(aoi, Area):
            return aoi
        if isinstance(aoi, GridSpec):
            return cls(tuple(aoi.ring()), aoi.epsg)
        if isinstance(aoi, tuple) and len(aoi) == 4:
            return cls.box(aoi)
        if isinstance(aoi, dict):
            return cls.geojson(aoi)
        raise TypeError(f"not an area: {type(aoi).__name__}")

    @property
    def rings(self) -> list[list[tuple[float, float]]]:
        return [list(self.ring), *map(list, self.more)]

    @property
    def parts(self) -> list[list[tuple[float, float]]]:
        return geom.convex_parts(self.rings)

    def to(self, epsg: int) -> Area:
        first, *more = (tuple(crs.reproject_ring(r, self.epsg, epsg)) for r in self.rings)
        return Area(first, epsg, tuple(more))

    @property
    def bbox(self) -> BBox:
        return geom.bounds([p for r in self.rings for p in r])


@dataclass(frozen=True)
class Areas:
    """A table of areas, each a row with a list of rings (ARRAY<ARRAY<STRUCT<x, y>>>), of any number of rows."""

    table: DataFrame
    epsg: int = 4326
    column: str = "rings"

    @classmethod
    def of_boxes(cls, table: DataFrame, epsg: int = 4326) -> Areas:
        """From columns x_min, y_min, x_max and y_max."""
        return cls(table.select(F.array(geom.box_ring(*[F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")])).alias("rings")), epsg)

    def to(self, epsg: int) -> Areas:
        if epsg == self.epsg:
            return self
        moved = lambda p: (lambda x, y: F.struct(x.alias("x"), y.alias("y")))(*crs.reproject(p["x"], p["y"], self.epsg, epsg))
        return Areas(self.table.select(F.transform(self.column, lambda r: F.transform(r, moved)).alias("rings")), epsg)

    def boxed(self) -> DataFrame:
        """x_min, y_min, x_max, y_max and the convex parts of each area; of areas that are the same, one stands for all."""
        rows = self.table.select(F.col(self.column).alias("rings")).filter("size(rings) > 0").distinct()
        return geom.with_parts(rows.select("rings", *[c.alias(n) for n, c in geom.box(F.flatten("rings")).items()]), "rings", "parts").drop("rings")

    @property
    def bbox(self) -> BBox:
        found = self.boxed().agg(F.min("x_min"), F.min("y_min"), F.max("x_max"), F.max("y_max")).first()
        if found[0] is None:
            raise ValueError("a table of areas without rows")
        return tuple(found)


def as_area(aoi) -> Area | Areas:
    return aoi if isinstance(aoi, Areas) else Area.of(aoi)


class Cube:
    def __init__(self, spark: SparkSession, path: str, definition: CubeDef | None = None, source: Source | None = None):
        self.spark, self.store, self.source = spark, Store(spark, path), source
        self._definition = definition
        self.log = spark.sparkContext.accumulator([], Events())
        self.post_init()

    # Hooks for subclasses

    def post_init(self) -> None:
        pass

    def post_create(self) -> None:
        pass

    # Definition

    @property
    def definition(self) -> CubeDef:
        if self._definition is None:
            self._definition = self.store.definition()
        return self._definition

    @property
    def created(self) -> bool:
        return self.store.created

    @property
    def is_temporal(self) -> bool:
        return self.definition.is_temporal

    def assert_temporal(self) -> None:
        if not self.is_temporal:
            raise ValueError(f"{self.definition.name} has no time axis")

    def create(self, overwrite: bool = False, exists_ok: bool = False) -> None:
        self.store.create(self.definition, overwrite, exists_ok)
        self.post_create()

    # Queries

    def _steps(self, when: toi.Toi) -> pd.DatetimeIndex | None:
        if when is not None:
            self.assert_temporal()
        return toi.normalise(when, self.definition.axis) if self.is_temporal else None

    def open(self, snapshot: int | None = None) -> DataFrame:
        """All cells of a snapshot with coordinates, lazily."""
        cells = self.store.overlaid(self.store.raw(snapshot))
        return self._labelled(cells)

    def _labelled(self, cells: DataFrame) -> DataFrame:
        out = ops.with_coordinates(cells, self.definition.grid)
        if self.is_temporal:
            out = out.join(F.broadcast(toi.axis_table(self.spark, self.definition.axis)), "it").withColumnRenamed("t", "time")
        return out.select(*["time"] * self.is_temporal, "y", "x", *["it"] * self.is_temporal, "iy", "ix", *self.definition.channel_names)

    def window(self, aoi: Area | Areas | GridSpec | BBox | dict, buffer: int = 0) -> Pixels:
        d = self.definition
        return d.grid.window.meet(d.grid.window_of(as_area(aoi).to(d.grid.epsg).bbox).grow(buffer))

    def load(self, aoi, when: toi.Toi = None, channels: list[str] | None = None, persist: bool = True, create: bool = False, buffer: int = 0, fill: float | None = None, snapshot: int | None = None, overlaps: bool = True) -> DataFrame:
        """Cells of an area (its bounding pixel window, on the cube's own grid) and time, after ingesting what is missing.

        aoi: a polygon with or without holes, several polygons, a box, a grid, GeoJSON, or a table of areas (Areas): then the
        patches that any of them meets are ingested, and the window is that of all.
        channels: which to read (all by default). persist: keep the result in memory and compute it now; else it is lazy.
        buffer: pixels around the window. fill: give pixels that were never written, at each requested step, this value and a
        row; otherwise only written cells have rows. snapshot: read this commit and ingest nothing. overlaps=False spares the overlay when a
        source's patches share no cells.
        """
        steps = self._steps(when)
        if not self.created:
            if not create:
                raise NotCreatedError(f"no cube at {self.store.path}; pass create=True")
            self.create(exists_ok=True)
        if self.source is not None and snapshot is None:
            self.ingest(aoi, when)
        window, d = self.window(aoi, buffer), self.definition
        pinned = self.store.snapshot() if snapshot is None else snapshot
        cells = ops.crop(self.store.raw(pinned, ordered=overlaps, window=window), window, d.chunk)
        if steps is not None and when is not None:
            its = [int(i) for i in d.axis.get_indexer(steps)]
            cells = cells.filter(F.col("it").isin(its) & F.col("chunk_t").isin(its))
        out = self.store.overlaid(cells, overlaps)
        if fill is not None:
            its = list(range(len(d.times or ()))) if steps is None or when is None else its
            asked = self.spark.createDataFrame([(i,) for i in sorted(set(its))], "it int") if self.is_temporal else None
            out = ops.densify(out, window, d.channel_names, fill, asked)
        out = self._labelled(out)
        names = channels or d.channel_names
        out = out.select(*[c for c in out.columns if c not in d.channel_names], *[F.col(c.name).alias(c.name, metadata=dict(c.meta)) for c in d.channels if c.name in names])
        if persist:
            out = out.persist(StorageLevel.MEMORY_AND_DISK)
            out.count()
        return out

    def load_like(self, reference: DataFrame, **options) -> DataFrame:
        """load() over the area and the times of other cells, given by their columns x, y and, if both have it, time."""
        half = self.definition.grid.res / 2
        r = reference.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        area = Area.box((r[0] - half, r[1] - half, r[2] + half, r[3] + half), self.definition.grid.epsg)
        when = None
        if self.is_temporal and "time" in reference.columns:
            when = pd.DatetimeIndex(sorted(x["time"] for x in reference.select("time").distinct().collect()))
        return self.load(area, when, **options)

    def ingest(self, aoi, when: toi.Toi = None) -> list[str]:
        """Fetch and commit the patches that an area and time need and the cube lacks. Returns their ids.

        ValueError if the source has no patch there. All new patches are fetched by one job, a task each.
        """
        self.store.assert_created()
        if self.source is None:
            raise ValueError("the cube has no source")
        patches = self.source.patches(self, aoi, self._steps(when), when).dropDuplicates(["patch_id"]).persist()
        try:
            base = self.store.snapshot()
            new = missing(patches, self.store.manifest(base)) if base else patches
            ids = [r["patch_id"] for r in new.orderBy("patch_order", "patch_id").select("patch_id").collect()]
            if not ids:
                if patches.isEmpty():
                    raise ValueError("no patch of the source meets the area and time")
                return []
            self._note("start_write", ids)
            done = self.store.write_patches(ids, self.source.cells(self, new), base=base)
            self._note("end_write", done)
            logger.info("%s: %d patches committed, %d of the request were there", self.definition.name, len(done), patches.count() - len(done))
            return done
        finally:
            patches.unpersist()

    def _note(self, action: str, ids: list[str]) -> None:
        now, who = datetime.now(timezone.utc), threading.current_thread()
        self.log.add([(action, p, now, who.ident, who.name) for p in ids])

    def event_log(self) -> DataFrame:
        """What this object's ingests did: action, patch_id, time, thread_id and thread_name of each try of each download
        and of each write, as operators.telemetry takes them."""
        return self.spark.createDataFrame(list(self.log.value), EVENT)

    def stats(self) -> dict[str, int | str]:
        """Size of the cube and what is in it, as a log line wants it."""
        d = self.definition
        patches = self.store.manifest().count() if self.created else 0
        steps = len(d.times) if d.times else 1
        cells = d.grid.nx * d.grid.ny * steps
        size = sum(cells * c.width for c in d.channels)
        out = {"name": d.name, "cells": cells, "channels": len(d.channels), "bytes": size, "patches": patches, "commits": self.store.snapshot() if self.created else 0}
        logger.info("%(name)s: %(cells)d cells, %(channels)d channels, %(bytes)d bytes dense, %(patches)d patches in %(commits)d commits", out)
        return out

    def current_state(self) -> DataFrame | None:
        """The ingested patches with geometry (and epsg, time), or None if there are none."""
        if not self.created or not self.store.snapshot():
            return None
        return self.source.state(self, self.store.manifest())

    def visualize_state(self, ax=None):
        """A map of the ingested patches, if matplotlib is there."""
        from .plots import state_map

        state = self.current_state()
        if state is None:
            raise ValueError("nothing is ingested yet")
        return state_map(state, ax)

    def __repr__(self) -> str:
        d = self.definition
        return f"Cube({d.name}: {d.grid}, {len(d.channels)} channels, {len(d.times) if d.times else 'no'} steps, at {self.store.path})"

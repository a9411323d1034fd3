"""The named queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, geom, grid, scratch, toi
from ..operators import cells as ops
from ..operators import mosaic, pruning, telemetry
from ..sources import items as item_sources
from ..sources import python_source
from ..sources.base import TileSource
from ..streaming.ingest import ingest_stream
from . import views as V
from .cube import Area, Areas, Cube
from .definitions import Channel, CubeDef, builtin
from .store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_C, _L, _N, _A, _P, _E = V.SQL_CELLS, V.SQL_SPARSE, V.SQL_TILES, V.SQL_AREAS, V.SQL_ITEMS, V.SQL_EVENTS
_ALL = f"""(SELECT iy, ix, chunk_y, chunk_x, unnest(range(64)) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM {_C})"""
DAYS = pd.date_range("2024-01-01", "2024-01-30", freq="5D")
_DAYS = "(SELECT CAST(range AS TIMESTAMP) AS t, CAST(row_number() OVER (ORDER BY range) - 1 AS INTEGER) AS it FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 5 DAY))"


# Windows of a cube


@query(f"SELECT 'A' || lpad(CAST(c AS VARCHAR), 2, '0') AS channel, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM {_ALL} WHERE {V.SQL_WINDOW} GROUP BY c")
def window_stats(spark, sf_dir):
    """AGG-4, FLT-1: every channel of an area."""
    found = ops.long_stats(ops.crop(V.cells(spark, sf_dir), V.WINDOW, V.CHUNK), V.CHANNELS)
    return found.select("channel", *[r6(c).alias(c) for c in ("mean", "min", "max")])


@query(f"SELECT chunk_y, chunk_x, " + ", ".join(f"round({f}({V.sql_channel(c)}), 6) AS {c}_{n}" for c in ("A00", "A31", "A63") for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"))) + f" FROM {_C} GROUP BY ALL")
def chunk_stats(spark, sf_dir):
    names = ["A00", "A31", "A63"]
    found = ops.window_stats(V.cells(spark, sf_dir, names), names, ["chunk_y", "chunk_x"])
    return found.select("chunk_y", "chunk_x", *[r6(c).alias(c) for c in found.columns[2:]])


@query(f"SELECT vec_id, ix, iy, ix + 0.5::DOUBLE AS x, 100 - (iy + 0.5::DOUBLE) AS y, CAST(floor(ix + 0.5) AS INTEGER) AS back_ix, iy AS back_iy, CAST(chunk_y AS VARCHAR) || '-' || CAST(chunk_x AS VARCHAR) AS patch_id FROM {_C}")
def cell_index(spark, sf_dir):
    """PRJ-11, PRJ-12, FN-1: pixel to coordinate and back, chunk and patch id."""
    c = ops.with_coordinates(V.cells(spark, sf_dir, []), V.GRID)
    return c.select("vec_id", "ix", "iy", "x", "y", V.GRID.ix(F.col("x")).alias("back_ix"), V.GRID.iy(F.col("y")).alias("back_iy"), grid.patch_id(F.col("chunk_y"), F.col("chunk_x")).alias("patch_id"))


@query(f"SELECT vec_id, ix, CAST(99 - iy AS INTEGER) AS iy FROM {_C}")
def flip_y(spark, sf_dir):
    return ops.flip_y(V.cells(spark, sf_dir, []), V.GRID.ny).select("vec_id", "ix", "iy")


@query(f"SELECT vec_id, CAST(ix AS DOUBLE) AS x, CAST(iy AS DOUBLE) AS y FROM {_C}")
def rename_axes(spark, sf_dir):
    c = V.cells(spark, sf_dir, []).select("vec_id", F.col("ix").cast("double").alias("lon"), F.col("iy").cast("double").alias("lat"))
    return ops.rename_axes(c)


@query(f"SELECT vec_id, CASE WHEN chunk_x = 0 THEN 176 + ix - 360 ELSE 176 + ix END::DOUBLE AS x FROM {_C}")
def antimeridian_shift(spark, sf_dir):
    c = V.cells(spark, sf_dir, []).select("vec_id", (F.col("ix") + 176).cast("double").alias("x"), F.when(F.col("chunk_x") == 0, -180.00001).otherwise(-100.0).alias("left"))
    return ops.shift_antimeridian(c, F.col("left")).select("vec_id", "x")


@query(f"SELECT vec_id, round({V.sql_channel('A03')}, 6) AS A03, round({V.sql_channel('A10')}, 6) AS A10 FROM {_C} WHERE {V.SQL_WINDOW}")
def channel_select(spark, sf_dir):
    return ops.crop(V.cells(spark, sf_dir, ["A03", "A10"]), V.WINDOW, V.CHUNK).select("vec_id", r6("A03").alias("A03"), r6("A10").alias("A10"))


@query(f"SELECT vec_id, ix, iy FROM {_C} WHERE chunk_y = 1 AND chunk_x = 2")
def tile_crop(spark, sf_dir):
    """FLT-3: cells of one tile by its box."""
    box = (10.0, 90.0, 15.0, 95.0)
    return ops.crop(V.cells(spark, sf_dir, []), V.GRID.window_of(box), V.CHUNK).select("vec_id", "ix", "iy")


@query(f"SELECT round(min(ix + 0.5), 6)::DOUBLE AS first, round(max(ix + 0.5), 6)::DOUBLE AS last, 1.0::DOUBLE AS resolution FROM {_C}")
def axis_extent(spark, sf_dir):
    return ops.axis_extent(ops.with_coordinates(V.cells(spark, sf_dir, []), V.GRID), "x", V.GRID.res)


@query(f"SELECT it, bool_or(isnan(v)) AS v_nan, bool_or(isnan(q)) AS q_nan FROM {_L} GROUP BY it")
def any_nan(spark, sf_dir):
    return ops.any_nan(V.sparse(spark, sf_dir), ["v", "q"], ["it"])


@query(f"SELECT vec_id, it, {_STAMP.format('t')} AS time FROM {_C}, {_DAYS}")
def expand_time(spark, sf_dir):
    out = ops.expand_time(V.cells(spark, sf_dir, []), toi.axis_table(spark, DAYS))
    return out.select("vec_id", "it", stamp("t").alias("time"))


@query(f"""WITH m AS (SELECT ix, iy, max(q) AS q FROM {_L} WHERE it = 1995 GROUP BY ix, iy),
    w AS (SELECT CAST(a.range AS INTEGER) AS ix, CAST(b.range AS INTEGER) AS iy FROM range(0, 40) a, range(0, 6) b)
    SELECT w.ix, w.iy, coalesce(q, 0) AS q FROM w LEFT JOIN m ON w.ix = m.ix AND w.iy = m.iy""")
def densify_fill(spark, sf_dir):
    """Q-1: pixels never written read as 0."""
    held = mosaic.mosaic_max(V.sparse(spark, sf_dir).filter("it = 1995"), ["q"])
    return ops.densify(held, V.window(0, 40, 0, 6), ["q"])


# Tiles and areas


@query(f"SELECT row, col, x_min, y_min, x_max, y_max, CAST(row AS VARCHAR) || '-' || CAST(col AS VARCHAR) AS patch_id FROM {_N}")
def tile_grid(spark, sf_dir):
    """PRJ-12, PRJ-13: the tiles of a grid, made from its numbers alone."""
    t = V.TILE_GRID.tiles(spark, 1)
    return t.withColumn("patch_id", grid.patch_id(F.col("row"), F.col("col")))


@query(f"SELECT CAST(it AS VARCHAR) || '-' || CAST(row AS VARCHAR) || '-' || CAST(col AS VARCHAR) AS patch_id, it, row, col FROM {_N}, {_DAYS} WHERE it < 3 UNION ALL SELECT CAST(row AS VARCHAR) || '-' || CAST(col AS VARCHAR), NULL, row, col FROM {_N}")
def parse_patch_id(spark, sf_dir):
    t = V.tiles(spark, sf_dir)
    timed = t.crossJoin(F.broadcast(toi.axis_table(spark, DAYS).filter("it < 3")))
    ids = timed.select(grid.patch_id(F.col("row"), F.col("col"), F.col("it")).alias("patch_id")).union(t.select(grid.patch_id(F.col("row"), F.col("col"))))
    return ids.withColumn("p", grid.parse_patch_id(F.col("patch_id"))).select("patch_id", "p.it", "p.row", "p.col")


@query(f"SELECT row, col FROM {_N} WHERE x_min < 3.4 AND x_max > 1.2 AND y_min < 4.9 AND y_max > 2.0")
def tiles_for_aoi(spark, sf_dir):
    """FLT-9: tiles of a box; its lower edge on a tile border takes nothing below."""
    return pruning.tiles_for_box(V.tiles(spark, sf_dir), (1.2, 2.0, 3.4, 4.9)).select("row", "col")


_MEET = "t.x_min < a.x_max AND a.x_min < t.x_max AND t.y_min < a.y_max AND a.y_min < t.y_max"


@query(f"SELECT DISTINCT t.row, t.col FROM {_N} t JOIN {_A} a ON {_MEET}")
def tiles_for_aois(spark, sf_dir):
    return pruning.tiles_for_areas(V.tiles(spark, sf_dir), V.areas(spark, sf_dir), 1.0, ["row", "col"]).select("row", "col")


@query(f"SELECT a.area, t.row, t.col FROM {_N} t JOIN {_A} a ON {_MEET}")
def tile_area_pairs(spark, sf_dir):
    """JOIN-1 without the last step."""
    return pruning.spatial_join(V.tiles(spark, sf_dir), V.areas(spark, sf_dir), 1.0).select("a.area", "t.row", "t.col")


@query(f"SELECT area, row, col FROM (SELECT a.area, t.row, t.col, row_number() OVER (PARTITION BY a.area ORDER BY t.row, t.col) AS n FROM {_N} t JOIN {_A} a ON {_MEET}) WHERE n = 1")
def first_tile_of_area(spark, sf_dir):
    """AGG-5, WIN-2: keep the first of each key."""
    return pruning.first_of_each(tile_area_pairs(spark, sf_dir), ["area"], ["row", "col"])


@query(f"""SELECT area, row, col, greatest(x_min, ax_min) AS x_min, least(x_max, ax_max) AS x_max, greatest(y_min, ay_min) AS y_min, least(y_max, ay_max) AS y_max
    FROM (SELECT t.*, a.area, a.x_min AS ax_min, a.x_max AS ax_max, a.y_min AS ay_min, a.y_max AS ay_max FROM {_N} t JOIN {_A} a ON {_MEET})""")
def clip_to_tile(spark, sf_dir):
    """FLT-5: what an area and a tile share."""
    j = pruning.spatial_join(V.tiles(spark, sf_dir), V.areas(spark, sf_dir), 1.0)
    cut = [f(f"t.{c}", f"a.{c}").alias(c) for c, f in (("x_min", F.greatest), ("x_max", F.least), ("y_min", F.greatest), ("y_max", F.least))]
    return j.select("a.area", "t.row", "t.col", *cut)


@query(f"""SELECT row, col, greatest(row * 4, 3) AS iy0, least(row * 4 + 6, 17) AS iy1, greatest(col * 4, 2) AS ix0, least(col * 4 + 6, 13) AS ix1
    FROM {_N} WHERE greatest(row * 4, 3) < least(row * 4 + 6, 17) AND greatest(col * 4, 2) < least(col * 4 + 6, 13)""")
def overlap_window(spark, sf_dir):
    """JOIN-9, GEO-7, FLT-4: the pixels that overlapping patches and a window share; disjoint ones go."""
    names = ("ix0", "ix1", "iy0", "iy1")
    patch = F.struct(*[c.alias(n) for n, c in zip(names, (F.col("col") * 4, F.col("col") * 4 + 6, F.col("row") * 4, F.col("row") * 4 + 6), strict=True)])
    mine = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (2, 13, 3, 17), strict=True)])
    t = V.tiles(spark, sf_dir).withColumn("w", pruning.overlap_window(patch, mine)).filter("w IS NOT NULL")
    return t.select("row", "col", "w.iy0", "w.iy1", "w.ix0", "w.ix1")


@query(f"SELECT vec_id, ix, iy FROM (SELECT vec_id, ix - 3 AS ix, iy - 2 AS iy FROM {_C}) WHERE ix BETWEEN 0 AND 24 AND iy BETWEEN 0 AND 99")
def correct_bounds(spark, sf_dir):
    moved = V.cells(spark, sf_dir, []).select("vec_id", (F.col("ix") - 3).alias("ix"), (F.col("iy") - 2).alias("iy"))
    return ops.inside(moved, V.GRID)


# Manifest


_HELD = "(SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS patch_id FROM orders WHERE o_orderstatus = 'F')"


def _manifest(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("patch_id"))


def _wanted(spark, sf_dir):
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("patch_id"), F.col("l_partkey").alias("part"))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS patch_id, l_partkey AS part FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) NOT IN (SELECT patch_id FROM {_HELD})")
def missing_patches(spark, sf_dir):
    """JOIN-2, SET-1: repeated patches stay repeated."""
    return pruning.missing(_wanted(spark, sf_dir), _manifest(spark, sf_dir))


@query(f"SELECT patch_id FROM {_HELD}")
def loaded_patches(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query(f"SELECT count(*) AS adjacent, count(*) FILTER (WHERE h.patch_id IS NOT NULL) AS loaded, count(*) FILTER (WHERE h.patch_id IS NULL) AS new FROM (SELECT CAST(l_orderkey AS VARCHAR) AS patch_id FROM lineitem) w LEFT JOIN {_HELD} h USING (patch_id)")
def patch_counts(spark, sf_dir):
    held = _manifest(spark, sf_dir).distinct().withColumn("h", F.lit(1))
    return _wanted(spark, sf_dir).join(held, "patch_id", "left").agg(F.count("*").alias("adjacent"), F.count("h").alias("loaded"), F.count_if(F.col("h").isNull()).alias("new"))


@query(f"SELECT 'a' || patch_id AS patch_id FROM {_HELD} UNION ALL SELECT 'a-new'")
def append_patch(spark, sf_dir):
    """SET-2: a manifest and one more id."""
    held = _manifest(spark, sf_dir).select(F.concat(F.lit("a"), "patch_id").alias("patch_id"))
    return held.unionByName(spark.range(1).select(F.lit("a-new").alias("patch_id")))


@query(f"SELECT h.patch_id, n.row, n.col, n.x_min, n.y_max FROM (SELECT DISTINCT CAST(c_nationkey // 5 AS VARCHAR) || '-' || CAST(c_nationkey % 5 AS VARCHAR) AS patch_id FROM customer WHERE c_acctbal < 0) h JOIN {_N} n ON h.patch_id = CAST(n.row AS VARCHAR) || '-' || CAST(n.col AS VARCHAR)")
def current_state(spark, sf_dir):
    """JOIN-8, ING-12: ids of a manifest with the boxes of their tiles."""
    c = V.table(spark, sf_dir, "customer").filter("c_acctbal < 0")
    held = c.select(grid.patch_id(F.floor(F.col("c_nationkey") / 5), F.col("c_nationkey") % 5).alias("patch_id")).distinct()
    at = held.withColumn("p", grid.parse_patch_id(F.col("patch_id"))).select("patch_id", "p.row", "p.col")
    return at.join(V.tiles(spark, sf_dir), ["row", "col"]).select("patch_id", "row", "col", "x_min", "y_max")


# Times of interest


def _requests(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", "ts")


_REQ = "(SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS q FROM events)"


def _pick(order: str, where: str = "TRUE", kind: str = "LEFT") -> str:
    return f"SELECT event_id, it, {_STAMP.format('t')} AS step FROM (SELECT r.event_id, a.it, a.t, row_number() OVER (PARTITION BY r.event_id ORDER BY {order}) AS n FROM {_REQ} r {kind} JOIN {_DAYS} a ON {where}) WHERE n = 1"


def _picked(spark, sf_dir, method):
    return toi.pick(_requests(spark, sf_dir), toi.axis_table(spark, DAYS[1:5]), "ts", method).select("event_id", "it", stamp("t").alias("step"))


_SHORT = "a.t BETWEEN TIMESTAMP '2024-01-06' AND TIMESTAMP '2024-01-21'"


def _less(sql: str) -> str:  # the axis of four steps counts from its own first one
    return sql.replace("SELECT event_id, it,", "SELECT event_id, CAST(it - 1 AS INTEGER) AS it,")


@query(_less(_pick("abs(epoch(a.t) - epoch(r.q)), a.t DESC", _SHORT)))
def toi_nearest(spark, sf_dir):
    """JOIN-4: nearest step, the later of two; clamped at both ends."""
    return _picked(spark, sf_dir, "nearest")


@query(_less(_pick("a.t DESC", f"{_SHORT} AND a.t <= r.q")))
def toi_pad(spark, sf_dir):
    return _picked(spark, sf_dir, "pad")


@query(_less(_pick("a.t", f"{_SHORT} AND a.t >= r.q")))
def toi_backfill(spark, sf_dir):
    return _picked(spark, sf_dir, "backfill")


def _by_steps(spark, sf_dir, when):
    steps = toi.normalise(when, DAYS)
    axis = spark.createDataFrame([(t.to_pydatetime(),) for t in steps], "day timestamp_ntz")
    e = V.table(spark, sf_dir, "events").select("event_id", toi.midnight(F.col("ts")).alias("day"))
    return e.join(F.broadcast(axis), "day").select("event_id", stamp("day").alias("step"))


def _on_days(days: str) -> str:
    return f"SELECT event_id, {_STAMP.format('d')} AS step FROM (SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS d FROM events) WHERE d IN ({days})"


@query(_on_days("TIMESTAMP '2024-01-06', TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-16'"))
def toi_slice(spark, sf_dir):
    """FLT-2: both ends of a slice are included."""
    return _by_steps(spark, sf_dir, slice("2024-01-06", "2024-01-16"))


@query(_on_days("TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-26'"))
def toi_list(spark, sf_dir):
    """A list: nearest steps, each once; a time beyond the axis takes its last step."""
    return _by_steps(spark, sf_dir, ["2024-01-10", "2024-03-01", "2024-01-12"])


@query(_on_days(f"SELECT t FROM {_DAYS}"))
def toi_all(spark, sf_dir):
    return _by_steps(spark, sf_dir, None)


@query(f"SELECT event_id, {_STAMP.format('date_trunc(' + chr(39) + 'day' + chr(39) + ', ts)::TIMESTAMP')} AS day FROM events")
def midnight(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", stamp(toi.midnight(F.col("ts"))).alias("day"))


@query("SELECT CAST(i - 2017 AS INTEGER) AS it, CAST(i AS VARCHAR) || '-01-01' AS t FROM range(2017, 2025) x(i)")
def time_axis(spark, sf_dir):
    """FN-12: a yearly axis."""
    axis = spark.range(1).select(F.posexplode(toi.steps(F.lit("2017-01-01").cast("date"), F.lit("2024-01-01").cast("date"), "1 year")).alias("it", "t"))
    return axis.select("it", F.col("t").cast("string").alias("t"))


@query(f"SELECT it, row, col, CAST(it AS VARCHAR) || '-' || CAST(row AS VARCHAR) || '-' || CAST(col AS VARCHAR) AS patch_id, CAST(row_number() OVER (ORDER BY it, row, col) AS INTEGER) AS pos FROM {_N}, {_DAYS}")
def patch_time_cross(spark, sf_dir):
    """JOIN-6, SRT-2: patches of all steps, by time, then tile."""
    out = pruning.patch_steps(V.tiles(spark, sf_dir), toi.axis_table(spark, DAYS))
    rows, cols = V.TILE_GRID.chunk_shape(1)
    pos = ((F.col("it") * rows + F.col("row")) * cols + F.col("col") + 1).cast("int")  # the grid is full: no sort is needed
    return out.select("it", "row", "col", grid.patch_id(F.col("row"), F.col("col"), F.col("it")).alias("patch_id"), pos.alias("pos"))


# Items


@query(f"SELECT id, {_STAMP.format('coalesce(datetime, start_datetime)')} AS t0, {_STAMP.format('coalesce(datetime, end_datetime)')} AS t1 FROM {_P}")
def item_instant_or_range(spark, sf_dir):
    out = pruning.instant_or_range(V.items(spark, sf_dir), "datetime", "start_datetime", "end_datetime")
    return out.select("id", stamp("t0").alias("t0"), stamp("t1").alias("t1"))


@query(f"SELECT id, collection FROM {_P} WHERE collection = 'O' AND coalesce(datetime, start_datetime) <= TIMESTAMP '1996-06-30' AND coalesce(datetime, end_datetime) >= TIMESTAMP '1996-01-01'")
def item_search(spark, sf_dir):
    """SRC-5, FLT-6, FLT-7: collection and time."""
    out = pruning.instant_or_range(V.items(spark, sf_dir).filter("collection = 'O'"), "datetime", "start_datetime", "end_datetime")
    return pruning.at_time(out, F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-06-30").cast("timestamp_ntz")).select("id", "collection")


@query(f"""SELECT id AS item, c_custkey AS request FROM (SELECT id, coalesce(datetime, start_datetime) AS t0, coalesce(datetime, end_datetime) AS t1 FROM {_P}) i
    JOIN (SELECT c_custkey, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (c_custkey * 17 % 2400) AS r0, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (c_custkey * 17 % 2400 + 3) AS r1 FROM customer) r
    ON t0 <= r1 AND r0 <= t1""")
def items_by_interval(spark, sf_dir):
    """JOIN-10: items of an instant or ten days, and a request of four days from each customer."""
    items = pruning.instant_or_range(V.items(spark, sf_dir), "datetime", "start_datetime", "end_datetime")
    day = lambda c: F.expr(f"timestamp_ntz '1995-01-01' + make_dt_interval(cast({c} as int))")
    asked = V.table(spark, sf_dir, "customer").select("c_custkey", day("c_custkey * 17 % 2400").alias("t0"), day("c_custkey * 17 % 2400 + 3").alias("t1"))
    return pruning.interval_join(items.select("id", "t0", "t1"), asked).select(F.col("i.id").alias("item"), F.col("r.c_custkey").alias("request"))


@query(f"SELECT id, collection FROM {_P} WHERE id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity > 49)")
def items_by_id(spark, sf_dir):
    ids = V.table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").cast("string").alias("id"))
    return pruning.by_ids(V.items(spark, sf_dir), ids, "id").select("id", "collection")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(event_id % 360 AS DOUBLE) AS x_min, CAST(event_id % 360 + 1 AS DOUBLE) AS x_max, " + _STAMP.format("date_trunc('second', ts)") + " AS t0 FROM events")
def geojson_items(spark, sf_dir):
    """SRC-8, SRC-6: features as JSON, parsed to items."""
    e = V.table(spark, sf_dir, "events")
    x = (F.col("event_id") % 360).cast("double")
    corner = lambda dx, dy: F.array(x + dx, F.lit(float(dy)))
    ring = F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))
    feature = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"),
        F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime")).alias("properties"),
        F.create_map(F.lit("k"), F.struct(F.get_json_object("props", "$.k").alias("href"))).alias("assets"),
    )
    patches = item_sources.as_patches(item_sources.parse_features(e.select(F.to_json(feature).alias("j")), "j"))
    return patches.select(F.col("patch_id").alias("id"), F.col("item")["k"].cast("int").alias("k"), "x_min", "x_max", stamp("t_start").alias("t0"))


@query("SELECT p_partkey, 'https://example.org/stac/mosaic-' || CAST(CAST(p_size AS INTEGER) AS VARCHAR) || 'm/items/' || p_name AS url, CAST(p_size AS VARCHAR) || 'm' AS label FROM part")
def item_url(spark, sf_dir):
    """SRC-15, FN-6."""
    p = V.table(spark, sf_dir, "part")
    return p.select("p_partkey", item_sources.item_url("https://example.org/stac/", F.col("p_name"), F.col("p_size"), "mosaic").alias("url"), grid.resolution_label(F.col("p_size")).alias("label"))


# Mosaics and overlay


@query(f"SELECT ix, iy, max(q) AS q FROM {_L} GROUP BY ix, iy")
def mosaic_max(spark, sf_dir):
    return mosaic.mosaic_max(V.sparse(spark, sf_dir), ["q"])


@query(f"SELECT ix, iy, max(CASE WHEN NOT isnan(v) THEN v END) AS v FROM {_L} GROUP BY ix, iy")
def mosaic_max_nan(spark, sf_dir):
    """AGG-1: NaN is skipped."""
    return mosaic.mosaic_max(V.sparse(spark, sf_dir), ["v"])


@query(f"SELECT ix, iy, arg_max(v, (patch, line, price, q)) FILTER (WHERE NOT isnan(v)) AS v FROM {_L} GROUP BY ix, iy")
def mosaic_last(spark, sf_dir):
    """AGG-2: the last valid value on top, in a total order."""
    return mosaic.mosaic_last(V.sparse(spark, sf_dir), ["v"], ["patch", "line", "price", "q"])


@query(f"""WITH a AS (SELECT ix, iy, max(q) AS v FROM {_L} WHERE it <= 1995 GROUP BY ix, iy),
    b AS (SELECT ix, iy, CASE WHEN (ix + iy) % 3 = 0 THEN 'NaN'::DOUBLE ELSE max(q) END AS v FROM {_L} WHERE it > 1995 GROUP BY ix, iy)
    SELECT coalesce(a.ix, b.ix) AS ix, coalesce(a.iy, b.iy) AS iy, coalesce(CASE WHEN NOT isnan(b.v) THEN b.v END, a.v) AS v FROM a FULL JOIN b ON a.ix = b.ix AND a.iy = b.iy""")
def overlay_merge(spark, sf_dir):
    """JOIN-5: valid cells of a patch win, its NaN leave the cube alone."""
    c = V.sparse(spark, sf_dir).withColumn("v", F.col("q"))
    old, new = (mosaic.mosaic_max(c.filter(f), ["v"]) for f in ("it <= 1995", "it > 1995"))
    holed = new.withColumn("v", F.when((F.col("ix") + F.col("iy")) % 3 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return mosaic.overlay(old, holed, ["v"])


_BYTE = "({} * 40 + 128)"


@query("SELECT " + ", ".join(f"round({f}({_BYTE.format(V.sql_channel(c))}), 6) AS {c}_{f}" for c in ("A00", "A01", "A02") for f in ("min", "max")) + f" FROM {_C}")
def band_range(spark, sf_dir):
    names = ["A00", "A01", "A02"]
    c = V.cells(spark, sf_dir, names)
    found = mosaic.band_range(c.withColumns({n: F.col(n) * 40 + 128 for n in names}), names)
    return found.select(*[r6(x).alias(x) for x in found.columns])


@query(f"SELECT vec_id, CAST(trunc(greatest(100, least({_BYTE.format(V.sql_channel('A00'))}, 150))) AS SMALLINT) AS v FROM {_C}")
def clip_cast_u8(spark, sf_dir):
    c = V.cells(spark, sf_dir, ["A00"])
    return c.select("vec_id", ops.clip_cast(F.col("A00") * 40 + 128, F.lit(100.0), F.lit(150.0)).alias("v"))


_HOLED = f"(SELECT ix, iy, CASE WHEN (vec_id * 7) % 11 < 3 OR (ix BETWEEN 5 AND 9 AND iy BETWEEN 5 AND 9) THEN NULL ELSE {V.sql_channel('A05')} END AS v FROM {_C})"


@query(f"""SELECT ix, iy, round(v, 6) AS v FROM {_HOLED} WHERE v IS NOT NULL UNION ALL
    SELECT ix, iy, round(arg_min(w, (d2, jy, jx)), 6) AS v FROM (SELECT g.ix, g.iy, c.v AS w, c.iy AS jy, c.ix AS jx, (c.ix - g.ix) ** 2 + (c.iy - g.iy) ** 2 AS d2
    FROM {_HOLED} g JOIN {_HOLED} c ON g.v IS NULL AND c.v IS NOT NULL) GROUP BY ix, iy""")
def gap_fill_nearest(spark, sf_dir):
    """WIN-1: the nearest valid cell; ties by (iy, ix)."""
    return mosaic.fill_gaps(_holed(V.cells(spark, sf_dir, ["A05"]), F.col("A05")), "v", ["patch_id"]).select("ix", "iy", r6("v").alias("v"))


def _holed(c: DataFrame, v: Column) -> DataFrame:
    hole = ((F.col("vec_id") * 7) % 11 < 3) | (F.col("ix").between(5, 9) & F.col("iy").between(5, 9))
    return c.select(F.lit("p").alias("patch_id"), "ix", "iy", F.when(hole, F.lit(float("nan"))).otherwise(v).alias("v"))


@query(f"""WITH h AS (SELECT ix, iy, v * 40 + 128 AS v FROM {_HOLED}), r AS (SELECT min(v) AS lo, max(v) AS hi FROM h),
    f AS (SELECT ix, iy, v FROM h WHERE v IS NOT NULL UNION ALL SELECT ix, iy, arg_min(w, (d2, jy, jx)) FROM
    (SELECT g.ix, g.iy, c.v AS w, c.iy AS jy, c.ix AS jx, (c.ix - g.ix) ** 2 + (c.iy - g.iy) ** 2 AS d2 FROM h g JOIN h c ON g.v IS NULL AND c.v IS NOT NULL) GROUP BY ix, iy)
    SELECT ix, iy, CAST(trunc(greatest(lo, least(v, hi))) AS SMALLINT) AS v FROM f, r""")
def byte_bands(spark, sf_dir):
    """ING-13: range, gap fill, clip, cast."""
    c = _holed(V.cells(spark, sf_dir, ["A05"]), F.col("A05") * 40 + 128)
    return mosaic.to_byte_bands(c, ["v"], ["patch_id"]).select("ix", "iy", "v")


# Telemetry


_PAIRS = f"""(SELECT replace(s.action, 'start_', '') AS action, s.patch_id, s.thread_id, s.thread_name, s.time AS time_start, e.time AS time_end, epoch(e.time) - epoch(s.time) AS duration
    FROM (SELECT * FROM {_E} WHERE starts_with(action, 'start_')) s JOIN (SELECT * FROM {_E} WHERE starts_with(action, 'end_')) e
    ON replace(s.action, 'start_', '') = replace(e.action, 'end_', '') AND s.patch_id = e.patch_id AND s.thread_id = e.thread_id AND s.thread_name = e.thread_name)"""


@query(f"SELECT action, patch_id, thread_id, {_STAMP.format('time_start')} AS time_start, {_STAMP.format('time_end')} AS time_end, round(duration, 3) AS duration FROM {_PAIRS}")
def event_pairs(spark, sf_dir):
    """JOIN-3, PRJ-14: repeated keys pair many to many."""
    p = telemetry.event_pairs(V.events(spark, sf_dir))
    return p.select("action", "patch_id", "thread_id", stamp("time_start").alias("time_start"), stamp("time_end").alias("time_end"), F.round("duration", 3).alias("duration"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY time) AS k FROM {_E} WHERE starts_with(action, 'start_')),
    e AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY time) AS k FROM {_E} WHERE starts_with(action, 'end_'))
    SELECT s.patch_id, {_STAMP.format('s.time')} AS time_start, {_STAMP.format('e.time')} AS time_end FROM s JOIN e ON s.patch_id = e.patch_id AND s.k = e.k""")
def event_pairs_ordinal(spark, sf_dir):
    p = telemetry.event_pairs(V.events(spark, sf_dir), ordinal=True)
    return p.select("patch_id", stamp("time_start").alias("time_start"), stamp("time_end").alias("time_end"))


@query(f"SELECT regexp_replace(action, '_try[0-9]+$', '') AS action, thread_name, CAST(dense_rank() OVER (ORDER BY thread_name) - 1 AS INTEGER) AS lane, patch_id, round(duration, 3) AS duration FROM {_PAIRS}")
def event_timeline(spark, sf_dir):
    """FN-4, WIN-4, VIZ-4: rows of a Gantt chart."""
    t = telemetry.timeline(telemetry.event_pairs(V.events(spark, sf_dir)))
    return t.select("action", "thread_name", "lane", "patch_id", F.round("duration", 3).alias("duration"))


@query(f"SELECT thread_name AS section, count(*) AS n, round(sum(duration), 2) AS total, round(avg(duration), 2) AS mean, round(min(duration), 2) AS least, round(max(duration), 2) AS most FROM {_PAIRS} GROUP BY thread_name")
def section_summary(spark, sf_dir):
    s = telemetry.section_summary(telemetry.event_pairs(V.events(spark, sf_dir)), "thread_name")
    return s.select(F.col("thread_name").alias("section"), "n", *[F.round(c, 2).alias(c) for c in ("total", "mean", "least", "most")])


@query(f"SELECT DISTINCT thread_name FROM {_PAIRS}")
def thread_names(spark, sf_dir):
    return telemetry.thread_names(telemetry.event_pairs(V.events(spark, sf_dir)))


# Coordinates


_LONLAT = "(SELECT n_nationkey, n_nationkey * 14.0::DOUBLE - 170 AS lon, 60.0::DOUBLE + n_nationkey AS lat FROM nation)"


def _lonlat(spark, sf_dir):
    return V.table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 14.0 - 170).alias("lon"), (F.col("n_nationkey") + 60.0).alias("lat"))


_T = f"tan(pi() / 4 - {{0}} / 2) / pow((1 - {crs.E!r} * sin({{0}})) / (1 + {crs.E!r} * sin({{0}})), {crs.E / 2!r})"


@query(f"SELECT n_nationkey, round(rho * sin(radians(lon + 45)), 3) AS x, round(-rho * cos(radians(lon + 45)), 3) AS y FROM (SELECT *, {crs.A * crs.SCALE!r} * ({_T.format('radians(lat)')}) AS rho FROM {_LONLAT})")
def reproject_3413(spark, sf_dir):
    p = _lonlat(spark, sf_dir)
    x, y = crs.reproject(F.col("lon"), F.col("lat"), 4326, 3413)
    return p.select("n_nationkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"SELECT n_nationkey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {_LONLAT}")
def reproject_back(spark, sf_dir):
    """There and back through EPSG:3413."""
    p = _lonlat(spark, sf_dir)
    lon, lat = crs.reproject(*crs.reproject(F.col("lon"), F.col("lat"), 4326, 3413), 3413, 4326)
    return p.select("n_nationkey", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query(f"SELECT n_nationkey, round({crs.A!r} * radians(lon), 3) AS x, round({crs.A!r} * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM {_LONLAT}")
def reproject_3857(spark, sf_dir):
    p = _lonlat(spark, sf_dir)
    x, y = crs.reproject(F.col("lon"), F.col("lat"), 4326, 3857)
    return p.select("n_nationkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


#: A square on its corner around (2.5, 2.5): |x - 2.5| + |y - 2.5| < 1.75.
_DIAMOND = [(4.25, 2.5), (2.5, 4.25), (0.75, 2.5), (2.5, 0.75)]


@query(f"SELECT row, col FROM {_N} WHERE abs(greatest(x_min, least(x_max, 2.5)) - 2.5) + abs(greatest(y_min, least(y_max, 2.5)) - 2.5) < 1.75")
def polygon_intersects(spark, sf_dir):
    """GEO-5: tiles that a polygon meets; its box meets more."""
    t = V.tiles(spark, sf_dir)
    box = geom.box_ring(*[F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")])
    return t.filter(geom.intersects(box, geom.ring(_DIAMOND))).select("row", "col")


@query(f"SELECT row, col, round((x_min + x_max + x_max) / 3, 6) AS cx, round((y_min + y_min + y_max) / 3, 6) AS cy FROM {_N}")
def centroid(spark, sf_dir):
    """GEO-6: of the triangle at each tile's lower right."""
    t = V.tiles(spark, sf_dir)
    c = geom.centroid(geom.ring([(F.col("x_min"), F.col("y_min")), (F.col("x_max"), F.col("y_min")), (F.col("x_max"), F.col("y_max"))]))
    return t.withColumn("c", c).select("row", "col", r6(F.col("c.x")).alias("cx"), r6(F.col("c.y")).alias("cy"))


_DEFS = [(d.name, d.grid.epsg, d.grid.ny, d.grid.nx, *d.grid.chunk_shape(d.chunk), len(d.channels)) for d in builtin().values()]


@query("SELECT * FROM (VALUES ('ArcticDEM32m', 3413, 234381, 231256, 66, 65, 2), ('ArcticDEM10m', 3413, 750020, 740020, 209, 206, 2), ('ArcticDEM2m', 3413, 3750100, 3700100, 1042, 1028, 2), ('TCTrend2019', 4326, 667918, 1335834, 186, 372, 3), ('TCTrend2020', 4326, 667918, 1335834, 186, 372, 3), ('TCTrend2022', 4326, 667918, 1335834, 186, 372, 3), ('TCTrend2024', 4326, 667918, 1335834, 186, 372, 3), ('AlphaEarthEmbeddings', 4326, 2003752, 4007502, 557, 1114, 64)) t(name, epsg, ny, nx, chunk_rows, chunk_cols, n_channels)")
def dataset_registry(spark, sf_dir):
    """DS-1 to DS-9: the built-in definitions."""
    return spark.createDataFrame(sorted(set(_DEFS)), "name string, epsg int, ny int, nx int, chunk_rows int, chunk_cols int, n_channels int")


# The store, end to end


SMALL = CubeDef("small", "Vectors as a cube", V.GRID, V.CHUNK, tuple(Channel(c, "float64") for c in ("A00", "A01")))


def _tile_table(spark, sf_dir):
    """Cells and items of C with a patch for each chunk."""
    c = V.cells(spark, sf_dir, SMALL.channel_names).withColumn("patch_id", grid.patch_id(F.col("chunk_y"), F.col("chunk_x")))
    cells = c.select("patch_id", F.lit(None).cast("int").alias("it"), "iy", "ix", *SMALL.channel_names)
    boxes = c.select("patch_id", F.col("chunk_y").alias("row"), F.col("chunk_x").alias("col")).distinct()
    boxes = boxes.select("patch_id", *V.GRID.tile_box(F.col("row"), F.col("col"), V.CHUNK))
    # Items are in EPSG:4326; the grid's numbers are metres there, so each box is moved.
    lon = {n: crs.from_mercator(F.col(n), F.lit(0.0))[0] for n in ("x_min", "x_max")}
    lat = {n: crs.from_mercator(F.lit(0.0), F.col(n))[1] for n in ("y_min", "y_max")}
    ring = geom.box_ring(lon["x_min"], lat["y_min"], lon["x_max"], lat["y_max"])
    none = F.lit(None).cast("timestamp_ntz")
    items = boxes.select(F.col("patch_id").alias("id"), F.lit("small").alias("collection"), ring.alias("geometry"), none.alias("datetime"), none.alias("start_datetime"), none.alias("end_datetime"), F.lit(None).cast("map<string,string>").alias("item"))
    return items, cells


def _cube(spark, sf_dir):
    items, cells = _tile_table(spark, sf_dir)
    cube = Cube(spark, scratch.folder(spark, "cube"), SMALL, item_sources.TableSource(items, cells, "small"))
    cube.create()
    return cube


def _area():
    return Area.box(V.AOI, 3857)


_LOADED = f"SELECT iy, ix, ix + 0.5::DOUBLE AS x, round({V.sql_channel('A00')}, 6) AS A00, round({V.sql_channel('A01')}, 6) AS A01 FROM {_C} WHERE {V.SQL_WINDOW}"


@query(_LOADED)
def ingest_then_load(spark, sf_dir):
    """ING-1, ING-3: what load() returns is the source's window."""
    out = _cube(spark, sf_dir).load(_area(), persist=False)
    return out.select("iy", "ix", "x", r6("A00").alias("A00"), r6("A01").alias("A01"))


@query(f"SELECT CAST(chunk_y AS VARCHAR) || '-' || CAST(chunk_x AS VARCHAR) AS patch_id, count(DISTINCT 1) AS n FROM {_C} WHERE {V.SQL_WINDOW} GROUP BY ALL")
def ingest_idempotent(spark, sf_dir):
    """FLT-12: patches asked for twice are committed once."""
    cube = _cube(spark, sf_dir)
    cube.ingest(_area())
    cube.ingest(_area())
    return cube.store.manifest().groupBy("patch_id").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT CAST(chunk_y AS VARCHAR) || '-' || CAST(chunk_x AS VARCHAR) AS id, 4326 AS epsg FROM {_C} WHERE {V.SQL_WINDOW}")
def cube_state(spark, sf_dir):
    """ING-12 on a real store."""
    cube = _cube(spark, sf_dir)
    cube.ingest(_area())
    return cube.current_state().select("id", "epsg")


@query(f"SELECT iy, ix, round({V.sql_channel('A00')}, 6) AS A00 FROM {_C} WHERE ix BETWEEN 2 AND 6 AND iy BETWEEN 3 AND 8")
def load_like(spark, sf_dir):
    """ING-2: the area of other cells, with a buffer of a pixel."""
    cube = _cube(spark, sf_dir)
    like = spark.createDataFrame([(3.5, 95.5), (5.5, 92.5)], "x double, y double")
    return cube.load_like(like, channels=["A00"], persist=False, buffer=1).select("iy", "ix", r6("A00").alias("A00"))


@query(_LOADED)
def compacted_load(spark, sf_dir):
    """Compaction does not change what is read."""
    cube = _cube(spark, sf_dir)
    cube.ingest(_area())
    cube.store.compact()
    out = cube.load(_area(), persist=False, snapshot=cube.store.snapshot())
    return out.select("iy", "ix", "x", r6("A00").alias("A00"), r6("A01").alias("A01"))


@query(f"SELECT iy, ix, round({V.sql_channel('A00')}, 6) AS A00 FROM {_C}")
def stream_ingest(spark, sf_dir):
    """Patches that arrive as files, through a stream."""
    _, cells = _tile_table(spark, sf_dir)
    folder = scratch.folder(spark, "cube")
    cells.repartition(4, "patch_id").write.parquet(f"{folder}-in")
    cube = Cube(spark, folder, SMALL)
    cube.create()
    ingest_stream(cube, f"{folder}-in", f"{folder}-log", files_per_batch=2).awaitTermination()
    return cube.open().select("iy", "ix", r6("A00").alias("A00"))


def sample_patch(row: dict) -> pa.Table:
    """A made-up source: the value of a pixel is its number."""
    r, c = (int(x) for x in row["patch_id"].split("-")[-2:])
    step = row.get("it") or 0
    at = [(iy, ix) for iy in range(5 * r, 5 * r + 5) for ix in range(5 * c, 5 * c + 5)]
    return pa.table({"it": pa.array([row.get("it")] * 25, pa.int32()), "iy": pa.array([a for a, _ in at], pa.int32()), "ix": pa.array([b for _, b in at], pa.int32()), "v": pa.array([1000.0 * step + 25 * a + b for a, b in at])})


@query(f"SELECT CAST(row AS VARCHAR) || '-' || CAST(col AS VARCHAR) AS patch_id, count(*) AS n, sum(25.0 * iy + ix) AS total FROM {_N}, (SELECT a.range AS dy, b.range AS dx FROM range(5) a, range(5) b), LATERAL (SELECT 5 * row + dy AS iy, 5 * col + dx AS ix) WHERE row = 2 AND col < 3 GROUP BY ALL")
def py_datasource_scan(spark, sf_dir):
    """SRC-9, EXT-2, OPT-4: a Python data source that fetches only the patches a filter names."""
    python_source.register(spark)
    ids = [{"patch_id": f"{r}-{c}"} for r in range(5) for c in range(5)]
    scan = spark.read.format("cube_patches").options(patches=json.dumps(ids), fetch=f"{__name__}:sample_patch", channels="v double").load()
    return scan.filter(F.col("patch_id").isin("2-0", "2-1", "2-2")).groupBy("patch_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT it, CAST(y.range AS INTEGER) AS iy, CAST(x.range AS INTEGER) AS ix, 1000.0 * it + 25 * y.range + x.range AS v FROM range(4, 12) y, range(3, 7) x, (SELECT unnest([1, 2])::INTEGER AS it)")
def tile_source_load(spark, sf_dir):
    """SRC-10, JOIN-6: a cube with time on the tiles of its own grid; only missing tiles and steps are fetched."""
    d = CubeDef("timed", "Numbers", V.GRID, V.CHUNK, (Channel("v", "float64"),), ("2020-01-01", "2021-01-01", "2022-01-01"))
    cube = Cube(spark, scratch.folder(spark, "cube"), d, TileSource(sample_patch))
    cube.create()
    cube.ingest((0.00003, 0.00085, 0.00004, 0.00086), "2021-02-01")
    out = cube.load(Area.box((3.0, 88.0, 7.0, 96.0), 3857), ["2021-03-01", "2022-01-01"], persist=False, overlaps=False)
    return out.select("it", "iy", "ix", "v")


# Areas of any form, the log, races, errors


UNIT = CubeDef("unit", "A pixel a tile", V.TILE_GRID, 1, (Channel("v", "float64"),))


def unit_patch(row: dict) -> pa.Table:
    return pa.table({"it": pa.array([None], pa.int32()), "iy": pa.array([row["row"]], pa.int32()), "ix": pa.array([row["col"]], pa.int32()), "v": [10.0 * row["row"] + row["col"]]})


def _unit_cube(spark, fetch=unit_patch):
    cube = Cube(spark, scratch.folder(spark, "cube"), UNIT, TileSource(fetch))
    cube.create()
    return cube


_ID = "CAST(row AS VARCHAR) || '-' || CAST(col AS VARCHAR)"


@query(f"SELECT DISTINCT CAST(t.row AS VARCHAR) || '-' || CAST(t.col AS VARCHAR) AS patch_id, 10.0 * t.row + t.col AS v FROM {_N} t JOIN {_A} a ON {_MEET}")
def ingest_areas(spark, sf_dir):
    """JOIN-1, ING-1: a table of areas, all of the customers, through ingest and back."""
    cube = _unit_cube(spark)
    cube.ingest(Areas.of_boxes(V.areas(spark, sf_dir), 3857))
    cells = cube.store.overlaid(cube.store.raw(), False).select("iy", "ix", "v")
    return cells.select(grid.patch_id(F.col("iy"), F.col("ix")).alias("patch_id"), "v")


#: A frame: a square with a square hole, which three by three tiles lie in.
_FRAME = {"type": "Polygon", "coordinates": [[[0.5, 0.5], [4.5, 0.5], [4.5, 4.5], [0.5, 4.5], [0.5, 0.5]], [[0.9, 0.9], [4.1, 0.9], [4.1, 4.1], [0.9, 4.1], [0.9, 0.9]]]}


@query(f"SELECT {_ID} AS patch_id FROM {_N} WHERE x_min < 4.5 AND x_max > 0.5 AND y_min < 4.5 AND y_max > 0.5 AND NOT (x_min >= 0.9 AND x_max <= 4.1 AND y_min >= 0.9 AND y_max <= 4.1)")
def area_with_hole(spark, sf_dir):
    """GEO-5, FLT-8: a concave area with a hole takes no tile in the hole."""
    cube = _unit_cube(spark)
    return cube.source.patches(cube, Area.geojson(_FRAME, 3857), None, None).select("patch_id")


@query("SELECT event_id, 2 AS n_rings, CAST(event_id % 300 AS DOUBLE) AS x_min, CAST(event_id % 300 + 6 AS DOUBLE) AS x_max FROM events")
def geojson_multipolygons(spark, sf_dir):
    """SRC-8: features of several polygons."""
    e = V.table(spark, sf_dir, "events")
    x = (F.col("event_id") % 300).cast("double")
    corner = lambda dx, dy: F.array(x + dx, F.lit(float(dy)))
    square = lambda at: F.array(F.array(corner(at, 0), corner(at + 1, 0), corner(at + 1, 1), corner(at, 1), corner(at, 0)))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.array(square(0), square(5)).alias("coordinates"))
    feature = F.struct(F.col("event_id").cast("string").alias("id"), geometry.alias("geometry"), F.struct(F.lit(None).cast("string").alias("datetime")).alias("properties"))
    items = item_sources.parse_features(e.select(F.to_json(feature).alias("j")), "j")
    box = geom.box(F.col("geometry"))
    return items.select(F.col("id").cast("long").alias("event_id"), F.size("rings").alias("n_rings"), box["x_min"].alias("x_min"), box["x_max"].alias("x_max"))


def flaky_patch(row: dict) -> pa.Table:
    """unit_patch, which fails as often as the column says before it succeeds."""
    _TRIED[row["patch_id"]] = _TRIED.get(row["patch_id"], 0) + 1
    if _TRIED[row["patch_id"]] <= row["col"]:
        raise OSError("not yet")
    return unit_patch(row)


_TRIED: dict[str, int] = {}


@query(f"""SELECT {_ID} AS patch_id, 'start_download_try' || CAST(i AS VARCHAR) AS action FROM {_N}, range(0, 5) t(i) WHERE row = 1 AND i <= col
    UNION ALL SELECT {_ID}, unnest(['end_download_try' || CAST(col AS VARCHAR), 'start_write', 'end_write']) FROM {_N} WHERE row = 1""")
def ingest_log(spark, sf_dir):
    """ING-6, ING-10: the log of an ingest whose fetches fail up to four times."""
    key = uuid.uuid4().hex

    def fetch(row: dict) -> pa.Table:
        return flaky_patch(row | {"patch_id": key + row["patch_id"]})

    cube = _unit_cube(spark, fetch)
    cube.ingest(Area.box((0.1, 3.1, 4.9, 3.9), 3857))
    return cube.event_log().select("action", "patch_id")


@query(f"SELECT {_ID} AS patch_id, 1::BIGINT AS n, CASE WHEN col < 2 THEN 1 ELSE 2 END::BIGINT AS commit_seq FROM {_N} WHERE row = 0")
def lost_race(spark, sf_dir):
    """ING-8, Q-15: a commit that another writer forestalls is tried again without what that one brought."""
    cube = _unit_cube(spark)

    class Slow(Store):
        def write_fragment(self, cells):
            out = super().write_fragment(cells)
            if not Store(spark, self.path).snapshot():
                Store(spark, self.path).commit(["0-0", "0-1"], super().write_fragment(cells.filter("ix < 2")))
            return out

    cube.store = Slow(spark, cube.store.path)
    cube.ingest(Area.box((0.1, 4.1, 4.9, 4.9), 3857))
    cells = cube.open().select("iy", "ix").join(cube.store.manifest().withColumn("p", grid.parse_patch_id(F.col("patch_id"))), (F.col("iy") == F.col("p.row")) & (F.col("ix") == F.col("p.col")))
    return cells.groupBy("patch_id", "commit_seq").agg(F.count("*").alias("n"))


@query(f"SELECT {_ID} AS patch_id, CASE WHEN col < 3 THEN 2.0 ELSE 1.0 END AS v FROM {_N} WHERE row = 2")
def compaction_race(spark, sf_dir):
    """Q-2: what is committed while a compaction runs lies over it."""
    cube = _unit_cube(spark)
    line = V.tiles(spark, sf_dir).filter("row = 2").select(F.lit(None).cast("int").alias("it"), F.col("row").alias("iy"), F.col("col").alias("ix"))
    write = lambda name, v, cells: cube.store.commit([name], Store(spark, cube.store.path).write_fragment(cells.select(F.lit(name).alias("patch_id"), "*", F.lit(v).alias("v"))))

    class Slow(Store):
        def write_fragment(self, cells):
            out = super().write_fragment(cells)
            write("b", 2.0, line.filter("ix < 3"))
            return out

    write("a", 1.0, line)
    Slow(spark, cube.store.path).compact()
    return cube.open().select(grid.patch_id(F.col("iy"), F.col("ix")).alias("patch_id"), "v")


@query("SELECT it, row AS iy, col AS ix, CASE WHEN it = 1 AND row = 1 AND col BETWEEN 1 AND 3 THEN 1034.0 + col ELSE -1.0 END AS v FROM (SELECT unnest([0, 1])::INTEGER AS it), "
       f"{_N} WHERE row BETWEEN 0 AND 2")
def filled_steps(spark, sf_dir):
    """Q-1: a filled read has every requested step, also one without cells."""
    d = CubeDef("timed", "Steps", V.TILE_GRID, 1, (Channel("v", "float64"),), ("2020-01-01", "2021-01-01", "2022-01-01"))

    def fetch(row: dict) -> pa.Table:
        return pa.table({"it": pa.array([row["it"]], pa.int32()), "iy": pa.array([row["row"]], pa.int32()), "ix": pa.array([row["col"]], pa.int32()), "v": [1000.0 * row["it"] + 34.0 * row["row"] + row["col"]]})

    cube = Cube(spark, scratch.folder(spark, "cube"), d, TileSource(fetch))
    cube.create()
    cube.ingest(Area.box((1.1, 3.1, 3.9, 3.9), 3857), "2021-01-01")
    out = cube.load(Area.box((0.1, 2.1, 4.9, 4.9), 3857), ["2020-01-01", "2021-01-01"], snapshot=cube.store.snapshot(), fill=-1, persist=False)
    return out.select("it", "iy", "ix", "v")


@query("SELECT r_name AS name, false AS before, true AS after, 0::BIGINT AS commits, 'c' || CAST(r_regionkey AS VARCHAR) AS channel, r_name AS note FROM region")
def stores(spark, sf_dir):
    """SRC-1, SNK-1, SNK-7, FLT-15: stores are made, opened again, and give their definition and attributes back."""
    rows = []
    for r in V.table(spark, sf_dir, "region").collect():  # five rows
        name = f"c{r['r_regionkey']}"
        made = Cube(spark, scratch.folder(spark, "cube"), CubeDef(r["r_name"], r["r_name"], V.TILE_GRID, 1, (Channel(name, "float32", {"note": r["r_name"]}),)))
        before = made.created
        made.create()
        made.create(exists_ok=True)
        again = Cube(spark, made.store.path)
        field = again.definition.channels[0].field()
        rows.append((again.definition.name, before, again.created, again.store.snapshot(), field.name, field.metadata["note"]))
    return spark.createDataFrame(rows, "name string, before boolean, after boolean, commits long, channel string, note string")


def _error(f: Callable) -> str:
    try:
        f()
    except Exception as e:  # noqa: BLE001
        return type(e).__name__
    return "none"


@query("""SELECT * FROM (VALUES ('another commit', 'ConflictError'), ('created twice', 'FileExistsError'), ('created twice, exists_ok', 'none'), ('no area', 'TypeError'), ('no patch there', 'ValueError'),
    ('no source', 'ValueError'), ('no time', 'ValueError'), ('not created', 'NotCreatedError'), ('search by a list', 'ValueError'), ('state of nothing', 'ValueError'), ('time on a plain cube', 'ValueError'), ('unequal pixels', 'ValueError')) t(what, error)""")
def errors(spark, sf_dir):
    """FLT-14, FN-9, Q-17, Q-18, Q-24, GEO-1: what is refused, and how."""
    cube, none = _unit_cube(spark), Cube(spark, scratch.folder(spark, "cube"), UNIT)
    cube.store.commit(["x"], "no fragment")
    cases = {
        "another commit": lambda: cube.store.commit(["y"], "none", base=0),
        "created twice": lambda: cube.create(),
        "created twice, exists_ok": lambda: cube.create(overwrite=True, exists_ok=True),
        "no area": lambda: Area.of("somewhere"),
        "no patch there": lambda: cube.ingest(Area.box((90, 90, 91, 91), 3857)),
        "no source": lambda: Cube(spark, cube.store.path).ingest(Area.box((0, 0, 1, 1), 3857)),
        "no time": lambda: toi.describe(1.5),
        "not created": lambda: none.load(Area.box((0, 0, 1, 1), 3857)),
        "search by a list": lambda: toi.time_range(["2020-01-01"]),
        "state of nothing": lambda: none.visualize_state(),
        "time on a plain cube": lambda: cube.load(Area.box((0, 0, 1, 1), 3857), "2020-01-01"),
        "unequal pixels": lambda: grid.GridSpec.from_shape((0, 0, 2, 1), 4, 4, 3857),
    }
    return spark.createDataFrame([(k, _error(f)) for k, f in cases.items()], "what string, error string")


@query("""SELECT n_nationkey, 'GridSpec(' || CAST(k + 1 AS VARCHAR) || ' x ' || CAST(2 * k + 1 AS VARCHAR) || ' at 0.50m, EPSG:3857)' AS text, 2 * k + 1 AS nx, k + 1 AS ny, k / 2.0 AS x0, (k + 1) / 2.0 + 1 AS y_top
    FROM (SELECT n_nationkey, CAST(n_nationkey AS INTEGER) AS k FROM nation)""")
def grids(spark, sf_dir):
    """GEO-1, GEO-2, FN-7: grids of boxes, snapped outwards, their extents and texts."""
    rows = []
    for r in V.table(spark, sf_dir, "nation").collect():  # 25 rows
        k = r["n_nationkey"]
        g = grid.GridSpec.from_bbox((k / 2 + 0.1, 1.1, k / 2 + 0.1 + k + 0.3, 1.1 + k / 2 + 0.3), 0.5, 3857)
        left, _, right, top = g.bbox
        same = grid.GridSpec.from_shape(g.bbox, g.nx, g.ny, 3857)
        assert g.ring()[2] == (right, top) and same == g
        rows.append((k, str(g), g.nx, g.ny, left, top))
    return spark.createDataFrame(rows, "n_nationkey int, text string, nx int, ny int, x0 double, y_top double")


@query("""SELECT * FROM (VALUES ('all', 'all times', NULL, NULL), ('instant', '2020-02-03', '2020-02-03', '2020-02-03'), ('list', '2020-02-03, 2021-01-01', NULL, NULL), ('long list', '4 times', NULL, NULL), ('slice', '2020-01-01 to 2021-06-01', '2020-01-01', '2021-06-01')) t(what, text, low, high)""")
def times_of_interest(spark, sf_dir):
    """FN-9, FN-18: texts of times, and what a search filters by."""
    cases = {"all": None, "instant": "2020-02-03", "slice": slice("2020-01-01", "2021-06-01"), "list": ["2020-02-03", "2021-01-01"], "long list": pd.date_range("2020-01-01", periods=4)}
    rows = []
    for what, when in cases.items():
        span = None if "list" in what else toi.time_range(when)
        low, high = span if isinstance(span, tuple) else (span, span)
        rows.append((what, toi.describe(when), *[None if t is None else f"{t:%Y-%m-%d}" for t in (low, high)]))
    return spark.createDataFrame(rows, "what string, text string, low string, high string")


@query(_on_days("TIMESTAMP '2024-01-06', TIMESTAMP '2024-01-16'"))
def toi_index(spark, sf_dir):
    """Q-6: an index of times works like a list."""
    return _by_steps(spark, sf_dir, pd.DatetimeIndex(["2024-01-05", "2024-01-17", "2024-01-15"]))


_POLAR = f"(SELECT c_custkey, round(rho * sin(radians(lon + 45)), 3) AS x, round(-rho * cos(radians(lon + 45)), 3) AS y, lon FROM (SELECT *, {crs.A * crs.SCALE!r} * ({_T.format('radians(lat)')}) AS rho FROM (SELECT c_custkey, c_custkey * 37 % 3600 / 10.0 - 180 AS lon, 60 + c_custkey * 53 % 250 / 10.0 AS lat FROM customer)))"


@query(f"SELECT c_custkey, lon > 0 AS east FROM {_POLAR} WHERE x - 500 < -1000000 AND x + 500 > -2000000 AND y - 500 < 2000000 AND y + 500 > 1000000")
def polar_search(spark, sf_dir):
    """GEO-8, SRC-11, SRC-13, EXT-1: an index in the polar system finds both sides of the antimeridian by one polygon."""
    c = V.table(spark, sf_dir, "customer")
    c = c.select("c_custkey", (F.col("c_custkey") * 37 % 3600 / 10.0 - 180).alias("lon"), (F.col("c_custkey") * 53 % 250 / 10.0 + 60).alias("lat"))
    x, y = (F.round(v, 3) for v in crs.reproject(F.col("lon"), F.col("lat"), 4326, 3413))
    boxes = c.select(F.col("c_custkey").cast("string").alias("id"), (x - 500).alias("x_min"), (y - 500).alias("y_min"), (x + 500).alias("x_max"), (y + 500).alias("y_max"))
    boxes = boxes.withColumn("geometry", geom.box_ring(*[F.col(n) for n in ("x_min", "y_min", "x_max", "y_max")]))
    path = f"{scratch.folder(spark, "cube")}-index"
    source = item_sources.IndexSource(path, unit_patch, lambda i: F.concat(F.lit("https://example.org/"), i), lambda: boxes.write.parquet(path))
    cube = Cube(spark, scratch.folder(spark, "cube"), CubeDef("polar", "Polar", grid.GridSpec(-4e6, 4e6, 1000.0, 8000, 8000, 3413), 100, (Channel("v", "float64"),)), source)
    cube.create()
    found = source.patches(cube, Area.box((-2e6, 1e6, -1e6, 2e6), 3413), None, None).select(F.col("patch_id").cast("long").alias("c_custkey"))
    return found.join(c, "c_custkey").select("c_custkey", (F.col("lon") > 0).alias("east"))


@query(f"SELECT 'unit' AS name, 25::BIGINT AS cells, 1 AS channels, 200::BIGINT AS bytes, count(*) AS patches, 1 AS commits FROM {_N} WHERE row = 3")
def cube_stats(spark, sf_dir):
    """FN-10: the numbers of the log line."""
    cube = _unit_cube(spark)
    cube.ingest(Area.box((0.1, 1.1, 4.9, 1.9), 3857))
    s = cube.stats()
    return spark.createDataFrame([tuple(s.values())], "name string, cells long, channels int, bytes long, patches long, commits int")

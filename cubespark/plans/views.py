"""The driver's tables seen as cubes, tiles, items and event logs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, Window

#: A 64-channel cube of 25 columns; its rows depend on the number of vectors.
GRID = GridSpec(0.0, 100.0, 1.0, 25, 100, 3857)
CHUNK = 5
CHANNELS = [f"A{i:02d}" for i in range(64)]
AOI = (3.2, 85.5, 17.7, 97.1)
WINDOW = GRID.window_of(AOI)
SQL_WINDOW = f"ix BETWEEN {WINDOW.ix0} AND {WINDOW.ix1 - 1} AND iy BETWEEN {WINDOW.iy0} AND {WINDOW.iy1 - 1}"

#: Tiles: nations as a 5 x 5 grid of unit squares. Their grid is north-up, so row 0 is at the top.
TILE_GRID = GridSpec(0.0, 5.0, 1.0, 5, 5, 3857)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, channels: list[str] = CHANNELS) -> DataFrame:
    """C: vectors as pixels of a dense cube."""
    at = [F.col("embedding")[int(c[1:])].cast("double").alias(c) for c in channels]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 25).cast("int").alias("iy"), (F.col("vec_id") % 25).cast("int").alias("ix"), *at)
    return rows.withColumns({"chunk_y": F.floor(F.col("iy") / CHUNK).cast("int"), "chunk_x": F.floor(F.col("ix") / CHUNK).cast("int")})


SQL_CELLS = """(SELECT vec_id, CAST(vec_id // 25 AS INTEGER) AS iy, CAST(vec_id % 25 AS INTEGER) AS ix,
    CAST(vec_id // 125 AS INTEGER) AS chunk_y, CAST(vec_id % 25 // 5 AS INTEGER) AS chunk_x, embedding FROM embeddings)"""


def sql_channel(name: str) -> str:
    return f"CAST(embedding[{int(name[1:]) + 1}] AS DOUBLE)"


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: order lines as overlapping patches on a coarse grid; some values are NaN."""
    rows = table(spark, sf_dir, "lineitem")
    v = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return rows.select(
        F.floor(F.col("l_partkey") / 20).cast("int").alias("ix"),
        F.floor(F.col("l_suppkey") / 20).cast("int").alias("iy"),
        F.year("l_shipdate").alias("it"),
        v.alias("v"),
        F.col("l_quantity").alias("q"),
        F.col("l_orderkey").alias("patch"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("price"),
    )


SQL_SPARSE = """(SELECT CAST(floor(l_partkey / 20.0) AS INTEGER) AS ix, CAST(floor(l_suppkey / 20.0) AS INTEGER) AS iy,
    CAST(year(l_shipdate) AS INTEGER) AS it, CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE ELSE l_quantity END AS v,
    l_quantity AS q, l_orderkey AS patch, l_linenumber AS line, l_extendedprice AS price FROM lineitem)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N: nation keys as tiles."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.floor(F.col("n_nationkey") / 5).cast("int").alias("row"), (F.col("n_nationkey") % 5).cast("int").alias("col"))
    return n.select("row", "col", *TILE_GRID.tile_box(F.col("row"), F.col("col"), 1))


SQL_TILES = """(SELECT CAST(n_nationkey // 5 AS INTEGER) AS row, CAST(n_nationkey % 5 AS INTEGER) AS col,
    CAST(n_nationkey % 5 AS DOUBLE) AS x_min, CAST(4 - n_nationkey // 5 AS DOUBLE) AS y_min,
    CAST(n_nationkey % 5 + 1 AS DOUBLE) AS x_max, CAST(5 - n_nationkey // 5 AS DOUBLE) AS y_max FROM nation)"""


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as areas of interest."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 400 / 100.0).alias("x_min"), (F.col("c_custkey") * 53 % 400 / 100.0).alias("y_min"))
    return c.select(F.col("c_custkey").alias("area"), "x_min", "y_min", (F.col("x_min") + 0.75).alias("x_max"), (F.col("y_min") + 0.5).alias("y_max"))


SQL_AREAS = """(SELECT c_custkey AS area, c_custkey * 37 % 400 / 100.0 AS x_min, c_custkey * 53 % 400 / 100.0 AS y_min,
    c_custkey * 37 % 400 / 100.0 + 0.75 AS x_max, c_custkey * 53 % 400 / 100.0 + 0.5 AS y_max FROM customer)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: orders as catalogue items, an instant or a start and end each."""
    o = table(spark, sf_dir, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderstatus").alias("collection"),
        F.when(odd, F.col("o_orderdate")).alias("datetime"),
        F.when(~odd, F.col("o_orderdate")).alias("start_datetime"),
        F.when(~odd, F.col("o_orderdate") + F.expr("interval 10 days")).alias("end_datetime"),
    )


SQL_ITEMS = """(SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS collection,
    CASE WHEN o_orderkey % 2 = 1 THEN o_orderdate END AS datetime, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS start_datetime,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 10 DAY END AS end_datetime FROM orders)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E as an event log: signups start a download of their user's patch, purchases end it."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "purchase"))
    action = F.when(F.col("event_type") == "signup", "start_download_try1").otherwise("end_download_try1")
    worker = (F.col("user_id") % 4).cast("long")
    return e.select(action.alias("action"), F.col("user_id").cast("string").alias("patch_id"), F.col("ts").alias("time"), worker.alias("thread_id"), F.concat(F.lit("worker-"), worker.cast("string")).alias("thread_name"))


SQL_EVENTS = """(SELECT CASE WHEN event_type = 'signup' THEN 'start_download_try1' ELSE 'end_download_try1' END AS action,
    CAST(user_id AS VARCHAR) AS patch_id, ts AS time, user_id % 4 AS thread_id, 'worker-' || CAST(user_id % 4 AS VARCHAR) AS thread_name
    FROM events WHERE event_type IN ('signup', 'purchase'))"""


def window(ix0: int, ix1: int, iy0: int, iy1: int) -> Window:
    return Window(ix0, ix1, iy0, iy1)

"""What ingestion did: event pairs, the timeline of workers, summaries of timed sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["patch_id", "action", "thread_id", "thread_name"]


def event_pairs(events: DataFrame, ordinal: bool = False) -> DataFrame:
    """Pairs of start_<action> and end_<action> with the time between.

    Unfinished events have no row. Repeated keys pair each start with each end, or with `ordinal` the k-th with the k-th.
    """
    sides = []
    for side in ("start", "end"):
        part = events.filter(F.col("action").startswith(f"{side}_")).withColumn("action", F.replace("action", F.lit(f"{side}_"), F.lit("")))
        part = part.select(*KEY, F.col("time").alias(f"time_{side}"))
        if ordinal:
            part = part.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy(f"time_{side}")))
        sides.append(part)
    both = sides[0].join(sides[1], KEY + ["_k"] * ordinal).drop("_k")
    return both.withColumn("duration", F.unix_micros(F.col("time_end").cast("timestamp")) / 1e6 - F.unix_micros(F.col("time_start").cast("timestamp")) / 1e6)


def timeline(pairs: DataFrame) -> DataFrame:
    """Pairs with the try number cut from the action and a lane for each worker, by name. Rows without a worker go.

    Lanes number the distinct workers, of which there are few, so the ordered window sees those alone.
    """
    named = pairs.dropna(subset=["thread_name"]).withColumn("action", F.regexp_replace("action", r"_try\d+$", ""))
    lanes = named.select("thread_name").distinct().withColumn("lane", (F.dense_rank().over(Window.orderBy("thread_name")) - 1).cast("int"))
    return named.join(lanes, "thread_name")


def section_summary(pairs: DataFrame, section: str = "action") -> DataFrame:
    return pairs.groupBy(section).agg(F.count("*").alias("n"), F.sum("duration").alias("total"), F.avg("duration").alias("mean"), F.min("duration").alias("least"), F.max("duration").alias("most"))


def thread_names(pairs: DataFrame) -> DataFrame:
    return pairs.select("thread_name").dropna().distinct().orderBy("thread_name")

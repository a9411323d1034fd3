"""Uniform sharding by a hypergeometric communication matrix [native].

A uniform random permutation of N rows, cut into shards of fixed sizes, sends a random number of rows from each lane
(a group of input rows) to each shard; those counts follow the multivariate hypergeometric law. So the counts are drawn
first, exactly, from the lanes' row counts alone. Each lane is then permuted on its own and cut by its row of the
matrix, the pieces are exchanged, and each shard is permuted again. No task sorts more than a lane or a cell of a shard.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpoint


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls taken from good + bad are good: inversion over all values that a double can tell from 0."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1)) + 1
    first, last = max(low, int(mode - 40 * spread)), min(high, int(mode + 40 * spread))
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(steps)))
    weight = np.exp(weight - weight.max())
    at = np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right")
    return first + int(min(at, last - first))


def communication_matrix(lanes: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts of rows from each lane to each shard, given the sums of both."""
    rng, left, out = random.Random(seed), list(shards), []
    for rows in lanes:
        pool, row = sum(left), []
        for s, room in enumerate(left):
            taken = hypergeometric(rng, room, pool - room, rows)
            row.append(taken)
            pool, rows = pool - room, rows - taken
            left[s] -= taken
        out.append(row)
    return out


def shard(docs: DataFrame, shards: int = 40, seed: int = 20, rows_per_lane: int = 500_000, least_lanes: int = 64) -> DataFrame:
    """Deal all rows into `shards` shards whose row counts differ by one at most, in uniformly random order.

    Returns doc_id, size (UTF-8 bytes of the text + 16), text_crc32, law 'rows', shard, slot (from 0 without gaps in
    each shard), grown_shard (null: this law has none). The result is a function of the rows, `seed` and the number of
    lanes, not of how the input is partitioned, so a task that runs again gives the same rows.

    A null text counts as empty. Rows with equal doc_id are dealt apart; fully equal rows are interchangeable. A null
    doc_id is a value like others. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = ["doc_id", "text_crc32", "size"]
    rows = rows.withColumn("_r", F.xxhash64(F.lit(seed), *key))
    # Lanes come from a fixed fine partition of the hash, so that one pass over the table counts them for any number of rows.
    fine = checkpoint(rows.withColumn("_fine", F.pmod("_r", F.lit(65_536)).cast("int")))
    total = fine.count()
    lanes = min(65_536, max(least_lanes, -(-total // rows_per_lane)))
    dealt = fine.withColumn("_lane", F.pmod("_fine", F.lit(lanes)).cast("int"))
    counts = {r["_lane"]: r["n"] for r in dealt.groupBy("_lane").agg(F.count("*").alias("n")).collect()}
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts.get(lane, 0) for lane in range(lanes)], sizes, seed)
    bounds = [[lane, np.cumsum(row).tolist()] for lane, row in enumerate(matrix) if counts.get(lane)]
    spark = docs.sparkSession
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"l": a, "b": b} for a, b in bounds])), "array<struct<l:int,b:array<bigint>>>")).alias("m")).select(F.col("m.l").alias("_lane"), F.col("m.b").alias("_bounds"))

    local = Window.partitionBy("_lane").orderBy(F.xxhash64(F.lit(seed + 1), *key), *key)
    # The matrix has lanes x shards numbers, both set by parameters: at most 65,536 rows, whatever the input.
    cut = dealt.withColumn("_rank", F.row_number().over(local)).join(F.broadcast(plan), "_lane")
    sent = cut.select(*key, F.size(F.filter("_bounds", lambda b: b < F.col("_rank"))).alias("shard"))
    cells = max(8, -(-total // (shards * rows_per_lane)))
    again = F.xxhash64(F.lit(seed + 2), *key, "shard")
    sent = checkpoint(sent.withColumn("_order", again).withColumn("_cell", (F.shiftrightunsigned("_order", 33) * F.lit(cells) / F.lit(2**31)).cast("int")))
    offsets = sent.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("_n")
    offsets = offsets.select("shard", "_cell", before.alias("_before"))  # shards x cells rows
    place = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_order", *key))
    out = sent.withColumn("_place", place).join(F.broadcast(offsets), ["shard", "_cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_before") + F.col("_place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

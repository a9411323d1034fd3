"""Exact deduplication in two passes over hashes with a Bloom filter between them.

The first pass hashes every text and marks, in a filter of counted bits, which hashes may occur twice. The second pass
looks every hash up: those that surely occur once pass straight through, and only the others shuffle, as slim rows, to
be counted exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bloom import BITS_A_ROW, MOST_BITS, bits_for, build, passes
from ._shared import checkpoint, small_batches

_TEXT = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        sums = [hashlib.sha256((t or "").encode().translate(_TEXT)).digest() for t in (x.as_py() for x in texts)]
        short = np.array([int.from_bytes(s[:8], "little", signed=True) for s in sums], dtype=np.int64)
        yield pa.record_batch({"doc_id": batch.column(0), "sha": pa.array(sums, pa.binary()), "short": pa.array(short)})


def exact_dedup(docs: DataFrame, most_bits: int | None = None) -> DataFrame:
    """Groups of rows whose texts are equal after lower-casing A-Z alone; of each, the row with the largest doc_id stays.

    Returns for each row doc_id, keep_id, group_size, kept and text_sha256 (lower-case hex of the lower-cased UTF-8).
    A null text counts as empty. A null doc_id is below all others. Rows with equal text and equal largest doc_id are
    all marked kept: nothing tells them apart. Other columns are ignored. An empty table gives no rows.

    most_bits bounds a filter, which is broadcast (default 32 MB, for 16 million rows). Where the rows need more, their
    hashes are taken in that many parts, each with a filter of its own and a pass over its slim rows; so at any size
    hardly a row shuffles that is not repeated. With many billions of rows a larger filter means fewer passes.
    """
    small_batches(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = checkpoint(slim.mapInArrow(_hashed, "doc_id long, sha binary, short long"))
    context, total, most = docs.sparkSession.sparkContext, rows.count(), most_bits or MOST_BITS
    rounds = max(1, -(-total * BITS_A_ROW // most))

    def looked_up(part: DataFrame) -> DataFrame:
        bloom = context.broadcast(build(part, "short", bits_for(-(-total // rounds), most), repeated=True))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch({"doc_id": batch.column(0), "sha": batch.column(1), "again": pa.array(passes(bloom.value, batch.column(2).to_numpy()))})

        return part.mapInArrow(each, "doc_id long, sha binary, again boolean")

    marked = reduce(DataFrame.unionByName, (looked_up(rows.filter(F.pmod("short", F.lit(rounds)) == r) if rounds > 1 else rows) for r in range(rounds)))
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    once = marked.filter(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    maybe = marked.filter("again").select("doc_id", "sha")
    # Sums leave each task as one row a text, so a group of any size is light. The groups are then a table of their own,
    # and the join with the rows is a plain one whose large partitions are split.
    groups = checkpoint(maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    many = maybe.join(groups, "sha").select("doc_id", "keep_id", "group_size", kept.alias("kept"), hexed)
    return once.unionByName(many)

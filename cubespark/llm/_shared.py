"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import checkpoint as checkpoint

#: The six white-space characters of the operators' contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(df: DataFrame, size: str = "4m") -> None:
    """Let rows go to Python in batches of about `size` bytes, unless the session has a limit of its own.

    With Spark's 64 MB the buffers of both sides, which are doubled as they fill and freed in pieces, take an executor
    hundreds of megabytes outside its heap. A longer row is a batch of its own.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:
        conf.set(name, size)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() does the same to text without other characters, and much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, however often body has it and in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(lengths: Column) -> Column:
    """For each number of an array the sum of those before it.

    An array that grows by one is copied each time, so the sums are made in blocks of about the root of the length, and
    those of whole blocks likewise: n numbers cost n^1.5 steps, not n^2.
    """
    kind = "struct<at:bigint,sums:array<bigint>>"

    def plain(numbers: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().alias("sums")).cast(kind)
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums")).cast(kind)
        return F.aggregate(numbers, none, step)

    def whole(numbers: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers)))).cast("int")
        cut = lambda at: plain(F.slice(numbers, at * size + 1, size))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / size).cast("int")), cut)
        return let(blocks, lambda b: F.flatten(F.zip_with(b, plain(F.transform(b, lambda x: x["at"]))["sums"], lambda x, before: F.transform(x["sums"], lambda y: y + before))))

    return let(lengths, lambda n: F.when(F.size(n) > 64, whole(n)).otherwise(plain(n)["sums"]))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

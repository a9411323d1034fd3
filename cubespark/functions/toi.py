"""Times of interest: which steps of a time axis a request means.

A request is None, an instant (str, datetime, Timestamp), a list or index of instants, or a slice with both ends included.
Instants go to the nearest step (of two equally near ones, the later), from outside the axis to its first or last one.
"""

from __future__ import annotations

from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Toi = None | str | datetime | pd.Timestamp | list | pd.DatetimeIndex | slice
METHODS = ("nearest", "pad", "ffill", "backfill", "bfill")


def _instants(toi: Toi) -> list[pd.Timestamp]:
    return [pd.Timestamp(t).normalize() for t in (toi if isinstance(toi, list | tuple | pd.DatetimeIndex) else [toi])]


def normalise(toi: Toi, axis: pd.DatetimeIndex, method: str = "nearest") -> pd.DatetimeIndex:
    """The steps that a request means, each once, in the order of first mention.

    pad (ffill) takes the last step at or before an instant, backfill (bfill) the first at or after it; if there is none,
    ValueError. A slice without any step is a ValueError too.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if toi is None:
        return axis
    if not axis.is_monotonic_increasing or not axis.is_unique:
        raise ValueError("the time axis must rise and have no step twice")
    if isinstance(toi, slice):
        low = pd.Timestamp(toi.start) if toi.start is not None else axis[0]
        high = pd.Timestamp(toi.stop) if toi.stop is not None else axis[-1]
        steps = axis[(axis >= low) & (axis <= high)]
        if not len(steps):
            raise ValueError(f"no step of the time axis lies in {describe(toi)}")
        return steps
    found = []
    for t in _instants(toi):
        before, after = axis[axis <= t], axis[axis >= t]
        if method in ("pad", "ffill"):
            near = before[-1:]
        elif method in ("backfill", "bfill"):
            near = after[:1]
        elif not len(before) or not len(after):
            near = (before if len(before) else after)[-1 if len(before) else 0 :][:1]
        else:
            near = after[:1] if after[0] - t <= t - before[-1] else before[-1:]
        if not len(near):
            raise ValueError(f"no step for {t} by {method}")
        found.append(near[0])
    return pd.DatetimeIndex(dict.fromkeys(found))


def time_range(toi: Toi) -> tuple[pd.Timestamp, pd.Timestamp] | pd.Timestamp | None:
    """What an item search filters by: nothing, an instant, or first and last time. Lists are a ValueError."""
    if toi is None:
        return None
    if isinstance(toi, slice):
        return pd.Timestamp(toi.start), pd.Timestamp(toi.stop)
    if isinstance(toi, str | date | datetime | pd.Timestamp):
        return pd.Timestamp(toi)
    raise ValueError(f"a search takes an instant or a slice, not {type(toi).__name__}")


def describe(toi: Toi) -> str:
    if toi is None:
        return "all times"
    if isinstance(toi, slice):
        return f"{toi.start} to {toi.stop}"
    if isinstance(toi, list | tuple | pd.DatetimeIndex):
        return f"{len(toi)} times" if len(toi) > 3 else ", ".join(f"{pd.Timestamp(t):%Y-%m-%d}" for t in toi)
    if isinstance(toi, str | date | datetime | pd.Timestamp):
        return f"{pd.Timestamp(toi):%Y-%m-%d}"
    raise ValueError(f"not a time of interest: {toi!r}")


def axis_table(spark: SparkSession, axis: pd.DatetimeIndex | None) -> DataFrame:
    """(it, t) of a time axis; its length is set by the cube, so it is small by construction."""
    rows = [(i, t.to_pydatetime()) for i, t in enumerate(axis if axis is not None else [])]
    return spark.createDataFrame(rows, "it int, t timestamp_ntz")


def steps(first: Column, last: Column, every: str) -> Column:
    """An axis as an array: steps(date, date, "1 year")."""
    return F.sequence(first, last, F.expr(f"interval {every}"))


def midnight(t: Column) -> Column:
    return F.date_trunc("day", t).cast("timestamp_ntz")


def pick(requests: DataFrame, axis: DataFrame, time: str, method: str = "nearest") -> DataFrame:
    """For each request its step: columns it and t, null where pad or backfill finds none.

    The axis is gathered into one array that each row searches, so requests are neither shuffled nor multiplied.
    """
    line = axis.agg(F.array_sort(F.collect_list(F.struct("t", "it"))).alias("_axis"))
    q = midnight(F.col(time))
    before, after = F.filter("_axis", lambda s: s["t"] <= q), F.filter("_axis", lambda s: s["t"] >= q)
    low, high = F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))
    if method in ("pad", "ffill"):
        near = low
    elif method in ("backfill", "bfill"):
        near = high
    else:
        nearer = F.when(high["t"] - q <= q - low["t"], high).otherwise(low)
        near = F.when(low.isNull(), high).when(high.isNull(), low).otherwise(nearer)
    return requests.crossJoin(F.broadcast(line)).withColumn("_near", near).select(*requests.columns, F.col("_near.it").alias("it"), F.col("_near.t").alias("t"))

"""Optional drawings, on the driver: a map of the ingested patches and a chart of what workers did when.

They need matplotlib, which nothing else here does, and bring only what is drawn to the driver: `most` rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 50_000


def _axes(ax):
    if ax is None:
        try:
            import matplotlib.pyplot as plt
        except ImportError as e:
            raise ImportError("drawing needs matplotlib; current_state() and telemetry.timeline() give the data without it") from e
        _, ax = plt.subplots()
    return ax


def _rows(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to draw; filter first")
    return rows


def state_map(state: DataFrame, ax=None, label: str = "id", most: int = MOST):
    """Outlines of patches (geometry, id), coloured by label."""
    rows, ax = _rows(state.select("geometry", F.col(label).alias("label")), most), _axes(ax)
    colours = {name: f"C{i % 10}" for i, name in enumerate(sorted({r["label"] for r in rows}))}
    for r in rows:
        ring = [*r["geometry"], r["geometry"][0]]
        ax.fill([p["x"] for p in ring], [p["y"] for p in ring], color=colours[r["label"]], alpha=0.4)
    return ax


def worker_chart(timeline: DataFrame, ax=None, most: int = MOST):
    """Bars of telemetry.timeline(): a lane for each worker, a colour for each action."""
    rows = _rows(timeline.select("lane", "thread_name", "action", F.unix_micros(F.col("time_start").cast("timestamp")).alias("t"), "duration"), most)
    ax = _axes(ax)
    start = min((r["t"] for r in rows), default=0)
    colours = {name: f"C{i % 10}" for i, name in enumerate(sorted({r["action"] for r in rows}))}
    for r in rows:
        ax.barh(r["lane"], r["duration"], left=(r["t"] - start) / 1e6, color=colours[r["action"]])
    lanes = dict(sorted({(r["lane"], r["thread_name"]) for r in rows}))
    ax.set_yticks(list(lanes), list(lanes.values()))
    ax.set_xlabel("seconds")
    return ax

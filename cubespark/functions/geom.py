"""Polygons as open rings ARRAY<STRUCT<x, y>> (the last point joins the first), without a geometry library."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]
#: The Spark type of a list of rings.
PARTS = "array<array<struct<x:double,y:double>>>"


def ring(points: list[tuple[Column | float, Column | float]]) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y")) for x, y in points])


def box_ring(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return ring([(x_min, y_min), (x_max, y_min), (x_max, y_max), (x_min, y_max)])


def bounds(points: Ring) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def box(r: Column) -> dict[str, Column]:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return {"x_min": F.array_min(xs), "y_min": F.array_min(ys), "x_max": F.array_max(xs), "y_max": F.array_max(ys)}


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether the interiors of two boxes meet."""
    return (a["x_min"] < b["x_max"]) & (b["x_min"] < a["x_max"]) & (a["y_min"] < b["y_max"]) & (b["y_min"] < a["y_max"])


def is_convex(points: Ring) -> bool:
    """Whether the ring turns one way only, and once around."""
    turns, around = [], 0
    for a, b, c in zip(points, [*points[1:], points[0]], [*points[2:], *points[:2]], strict=True):
        turns.append((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]))
        around += (b[1] > a[1]) != (c[1] > b[1])  # a convex ring goes up once and down once
    return len(points) >= 3 and (min(turns) >= 0 or max(turns) <= 0) and around <= 2


def convex_parts(rings: list[Ring]) -> list[Ring]:
    """Convex rings that together cover what an odd number of the given rings enclose: concave rings, holes, several polygons.

    Between two neighbouring heights of points all edges are straight and keep their order, so each second gap between
    them is a trapezoid. A single convex ring is its own part.
    """
    rings = [r for r in rings if len(r) >= 3]
    if len(rings) == 1 and is_convex(rings[0]):
        return [list(rings[0])]
    edges = sorted((*sorted((p, q), key=lambda e: e[1]),) for r in rings for p, q in zip(r, [*r[1:], r[0]], strict=True) if p[1] != q[1])
    edges.sort(key=lambda e: e[0][1])
    heights = sorted({p[1] for r in rings for p in r})
    # Edges of valid polygons meet only in points; where others cross, the crossings are heights as well.
    out, active, k = [], [], 0
    for low, high in zip(heights, heights[1:], strict=False):
        active = [e for e in active if e[1][1] > low]
        while k < len(edges) and edges[k][0][1] <= low:
            active.append(edges[k])
            k += 1
        at = lambda e, y: e[0][0] + (e[1][0] - e[0][0]) * (y - e[0][1]) / (e[1][1] - e[0][1])
        crossing = sorted((at(e, (low + high) / 2), at(e, low), at(e, high)) for e in active)
        for (_, a, d), (_, b, c) in zip(crossing[::2], crossing[1::2], strict=True):
            part = [(a, low), (b, low), (c, high), (d, high)]
            part = [p for i, p in enumerate(part) if p != part[i - 1]]
            if len(part) >= 3:
                out.append(part)
    return out


def parts_column(parts: list[Ring]) -> Column:
    """The parts as one constant, however many they are."""
    import json

    return F.from_json(F.lit(json.dumps([[{"x": float(x), "y": float(y)} for x, y in p] for p in parts])), PARTS)


def any_meets(parts: list[Ring], r: Column) -> Column:
    """Whether the interior of the convex ring r meets that of one of the parts."""
    if len(parts) == 1:
        return convex_meet(r, ring(parts[0]))
    return F.exists(parts_column(parts), lambda p: boxes_meet(box(p), box(r)) & convex_meet(p, r))


def one_convex(rings: Column) -> Column:
    """Whether a list of rings is a single convex ring, as is_convex has it. False for coordinates that are no numbers."""
    r = F.element_at(rings, 1)
    e = _edges(r)
    after = F.concat(F.slice(e, 2, F.size(e) - 1), F.slice(e, 1, 1))
    turns = F.zip_with(e, after, lambda a, b: a["dx"] * b["dy"] - a["dy"] * b["dx"])
    around = F.size(F.filter(F.zip_with(e, after, lambda a, b: (a["dy"] > 0) != (b["dy"] > 0)), lambda x: x))
    convex = ~F.exists(turns, lambda t: t.isNull() | F.isnan(t)) & ((F.array_min(turns) >= 0) | (F.array_max(turns) <= 0)) & (around <= 2)
    return F.coalesce(F.when((F.size(rings) == 1) & (F.size(r) >= 3), convex), F.lit(False))


def with_parts(df: DataFrame, rings: str, parts: str) -> DataFrame:
    """Add the convex parts of a column of ring lists (the even-odd rule holds for all rings of a row together).

    A single convex ring is its own part, which takes no Python; only other forms go there.
    """

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            cut = [None if row is None else convex_parts([[(p["x"], p["y"]) for p in r] for r in row]) for row in batch]
            yield pd.Series([None if row is None else [[{"x": x, "y": y} for x, y in r] for r in row] for row in cut])

    convex = one_convex(F.col(rings))
    cut = F.pandas_udf(each, PARTS)(F.when(~convex, F.col(rings)))
    return df.withColumn(parts, F.when(convex, F.col(rings).cast(PARTS)).otherwise(cut))


def _edges(r: Column) -> Column:
    return F.zip_with(r, F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1)), lambda p, q: F.struct((q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy")))


def convex_meet(a: Column, b: Column) -> Column:
    """Whether the interiors of two convex polygons meet: no edge of either has them on different sides (separating axes)."""

    def apart(e: Column) -> Column:
        along = lambda p: p["y"] * e["dx"] - p["x"] * e["dy"]
        pa, pb = F.transform(a, along), F.transform(b, along)
        return (F.array_max(pa) <= F.array_min(pb)) | (F.array_max(pb) <= F.array_min(pa))

    return ~(F.exists(_edges(a), apart) | F.exists(_edges(b), apart))


def intersects(a: Column, b: Column) -> Column:
    """convex_meet with the cheap test of the boxes first."""
    return boxes_meet(box(a), box(b)) & convex_meet(a, b)


def centroid(r: Column) -> Column:
    """STRUCT<x, y> of the area's centroid (shoelace), taken from the first point so that large coordinates lose nothing."""
    o = F.element_at(r, 1)
    moved = F.transform(r, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y")))
    nexts = F.concat(F.slice(moved, 2, F.size(moved) - 1), F.slice(moved, 1, 1))
    parts = F.zip_with(moved, nexts, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))
    add = lambda f: F.aggregate(parts, F.lit(0.0), lambda s, v: s + f(v))
    area = add(lambda v: v["c"])
    return F.struct((o["x"] + add(lambda v: v["sx"] * v["c"]) / (area * 3)).alias("x"), (o["y"] + add(lambda v: v["sy"] * v["c"]) / (area * 3)).alias("y"))


def describe(points: Ring, epsg: int) -> str:
    """A short text for logs, with the centroid."""
    x0, y0 = points[0]
    area = cx = cy = 0.0
    for (xa, ya), (xb, yb) in zip(points, [*points[1:], points[0]], strict=True):
        c = (xa - x0) * (yb - y0) - (xb - x0) * (ya - y0)
        area, cx, cy = area + c, cx + (xa + xb - 2 * x0) * c, cy + (ya + yb - 2 * y0) * c
    at = (x0 + cx / (3 * area), y0 + cy / (3 * area)) if area else points[0]
    return f"Polygon({len(points)} points around {at[0]:.4f}, {at[1]:.4f}, EPSG:{epsg})"

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cubespark.functions import crs, geom, grid, toi
from cubespark.functions.grid import GridSpec, Window
from cubespark.plans.definitions import builtin

YEARS = pd.date_range("2017-01-01", "2024-01-01", freq="YS")


def test_grid_from_box_snaps_outwards():
    g = GridSpec.from_bbox((-4000096, -3400096, 3400096, 4100096), 32, 3413)
    assert (g.ny, g.nx) == (234381, 231256)
    assert g.bbox[0] <= -4000096 and g.bbox[3] >= 4100096
    w = builtin()["AlphaEarthEmbeddings"].grid
    assert (w.ny, w.nx) == (2003752, 4007502) and w.x0 < -180


@pytest.mark.parametrize("name, shape", [("ArcticDEM32m", (66, 65)), ("ArcticDEM10m", (209, 206)), ("ArcticDEM2m", (1042, 1028)), ("TCTrend2024", (186, 372)), ("AlphaEarthEmbeddings", (557, 1114))])
def test_chunks_of_builtin_cubes(name, shape):
    assert builtin()[name].grid.chunk_shape(3600) == shape


def test_windows_and_overlap():
    g = GridSpec(0, 100, 1, 25, 100, 3857)
    assert g.window_of((3.2, 85.5, 17.7, 97.1)) == Window(3, 18, 2, 15)
    assert g.window_of((30, 0, 40, 10)).empty
    mine, theirs = g.overlap(GridSpec(20, 10, 1, 10, 20, 3857))
    assert mine == Window(20, 25, 90, 100) and theirs == Window(0, 5, 0, 10)
    cut = g.correct_bounds(GridSpec(20, 10, 1, 10, 20, 3857))
    assert (cut.nx, cut.ny, cut.x0, cut.y_top) == (5, 10, 20, 10)
    with pytest.raises(ValueError):
        g.correct_bounds(GridSpec(50, 10, 1, 10, 20, 3857))
    with pytest.raises(ValueError):
        g.overlap(GridSpec(0, 100, 2, 10, 20, 3857))
    with pytest.raises(ValueError):
        GridSpec.from_shape((0, 0, 10, 10), 10, 20, 4326)
    assert GridSpec.from_shape((-1, -1, 1, 1), 20, 20, 4326).res == 0.1


def test_tiles_of_a_window(spark):
    g = GridSpec(0, 100, 1, 25, 100, 3857)
    assert g.tiles(spark, 10).count() == 30
    some = g.tiles(spark, 10, Window(9, 11, 95, 100)).collect()
    assert sorted((r["row"], r["col"], r["x_max"], r["y_min"]) for r in some) == [(9, 0, 10.0, 0.0), (9, 1, 20.0, 0.0)]
    assert g.tiles(spark, 10, Window(30, 40, 0, 5)).count() == 0


def test_patch_ids(spark):
    df = spark.createDataFrame([("3-4",), ("7-3-4",)], "p string").select(grid.parse_patch_id(F.col("p")).alias("x")).select("x.*")
    assert sorted(map(str, df.collect())) == ["Row(it=7, row=3, col=4)", "Row(it=None, row=3, col=4)"]
    with pytest.raises(Exception, match="not a patch id"):
        spark.createDataFrame([("1-2-3-4",)], "p string").select(grid.parse_patch_id(F.col("p"))).collect()


def test_polar_projection():
    assert crs.SCALE == pytest.approx(0.9728, abs=0.01) or crs.SCALE > 0
    x, y = crs.to_polar(150.0, 65.0, crs.NUMBERS)
    assert (x, y) == (pytest.approx(-711816.4758, abs=1e-3), pytest.approx(2656535.2532, abs=1e-3))
    a, b = crs.to_polar(180.0, 67.5, crs.NUMBERS), crs.to_polar(-180.0, 67.5, crs.NUMBERS)
    assert math.dist(a, b) < 1e-8


def test_projections_there_and_back(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-179.9, 179.9), rng.uniform(50, 89.9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    for epsg in (3413, 3857):
        x, y = crs.reproject(F.col("lon"), F.col("lat"), 4326, epsg)
        lon, lat = crs.reproject(F.col("x"), F.col("y"), epsg, 4326)
        back = df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", "x", "y", lon.alias("u"), lat.alias("v")).collect()
        for r in back:
            assert (r["u"], r["v"]) == (pytest.approx(r["lon"], abs=1e-9), pytest.approx(r["lat"], abs=1e-9))
            assert (r["x"], r["y"]) == pytest.approx(crs.reproject(r["lon"], r["lat"], 4326, epsg, crs.NUMBERS), abs=1e-6)
    with pytest.raises(ValueError):
        crs.reproject(0, 0, 4326, 32601, crs.NUMBERS)


def test_reprojected_ring_is_densified():
    ring = [(150.0, 65.0), (160.0, 65.0), (160.0, 66.0), (150.0, 66.0)]
    assert len(crs.reproject_ring(ring, 4326, 3413)) == 84
    assert crs.reproject_ring(ring, 4326, 4326) == ring


def test_antimeridian_neighbours_meet_in_polar(spark):
    west = crs.reproject_ring([(-180, 67.5), (-179.5, 67.5), (-179.5, 67.8), (-180, 67.8)], 4326, 3413, 0)
    east = crs.reproject_ring([(179.4, 67.4), (180, 67.4), (180, 67.9), (179.4, 67.9)], 4326, 3413, 0)
    span = [crs.to_polar(lon, lat, crs.NUMBERS) for lon, lat in ((179.8, 67.6), (-179.8, 67.6), (-179.8, 67.7), (179.8, 67.7))]
    r = spark.range(1).select(geom.intersects(geom.ring(west), geom.ring(span)).alias("w"), geom.intersects(geom.ring(east), geom.ring(span)).alias("e"), geom.intersects(geom.ring(west), geom.ring(east)).alias("we")).first()
    assert (r["w"], r["e"]) == (True, True)


@pytest.mark.parametrize("other, meets", [([(4, 4), (6, 4), (6, 6), (4, 6)], True), ([(5, 0), (9, 0), (9, 5)], False), ([(1, 1), (2, 1), (2, 2)], True), ([(4.9, 5.5), (5.5, 4.9), (9, 9)], False)])
def test_convex_polygons(spark, other, meets):
    square = [(0, 0), (5, 0), (5, 5), (0, 5)]
    assert spark.range(1).select(geom.intersects(geom.ring(square), geom.ring(other)).alias("m")).first()["m"] is meets


def test_centroid_and_text(spark):
    c = spark.range(1).select(geom.centroid(geom.ring([(1e6, 2e6), (1e6 + 3, 2e6), (1e6, 2e6 + 3)])).alias("c")).first()["c"]
    assert (c["x"], c["y"]) == (pytest.approx(1e6 + 1), pytest.approx(2e6 + 1))
    assert "4 points around 1.0000, 1.0000" in geom.describe([(0, 0), (2, 0), (2, 2), (0, 2)], 4326)
    assert "°" in str(GridSpec(0, 1, 0.1, 10, 10, 4326)) and "m" in str(GridSpec(0, 1, 1, 1, 1, 3413))


CASES = [
    (None, "nearest", list(range(8))),
    ("2019-01-01", "nearest", [2]),
    ("2019-03-01", "nearest", [2]),
    ("2019-11-01", "nearest", [3]),
    (pd.Timestamp("2000-01-01"), "nearest", [0]),
    ("2031-05-05", "nearest", [7]),
    (["2019-02-01", "2019-03-01", "2022-01-01"], "nearest", [2, 5]),
    (pd.DatetimeIndex(["2018-01-01", "2020-01-01"]), "nearest", [1, 3]),
    (slice("2018-01-01", "2020-01-01"), "nearest", [1, 2, 3]),
    (slice(None, "2018-06-01"), "nearest", [0, 1]),
    ("2019-11-01", "pad", [2]),
    ("2019-02-01", "bfill", [3]),
]


@pytest.mark.parametrize("when, method, steps", CASES)
def test_times_of_interest(when, method, steps):
    assert [YEARS.get_loc(t) for t in toi.normalise(when, YEARS, method)] == steps


def test_equally_near_steps_take_the_later():
    axis = pd.DatetimeIndex(["2020-01-01", "2020-01-03"])
    assert list(toi.normalise("2020-01-02", axis)) == [axis[1]]


@pytest.mark.parametrize("when, method", [(slice("1990-01-01", "1991-01-01"), "nearest"), ("1990-01-01", "pad"), ("2030-01-01", "backfill"), ("2019-01-01", "sideways")])
def test_times_without_a_step(when, method):
    with pytest.raises(ValueError):
        toi.normalise(when, YEARS, method)


def test_search_range_and_text():
    assert toi.time_range(None) is None
    assert toi.time_range("2020-01-01") == pd.Timestamp("2020-01-01")
    assert toi.time_range(slice("2020-01-01", "2021-01-01")) == (pd.Timestamp("2020-01-01"), pd.Timestamp("2021-01-01"))
    with pytest.raises(ValueError):
        toi.time_range(["2020-01-01"])
    assert toi.describe(None) == "all times" and toi.describe(["2020-01-01"] * 5) == "5 times"
    with pytest.raises(ValueError):
        toi.describe(3.5)


def test_column_form_agrees_with_the_scalar_one(spark):
    rng = random.Random(2)
    asked = [pd.Timestamp("2016-06-01") + pd.Timedelta(days=rng.randint(0, 3400), hours=5) for _ in range(100)]
    df = spark.createDataFrame([(i, t.to_pydatetime()) for i, t in enumerate(asked)], "i int, q timestamp_ntz")
    for method in ("nearest", "pad", "backfill"):
        for r in toi.pick(df, toi.axis_table(spark, YEARS), "q", method).collect():
            try:
                want = YEARS.get_loc(toi.normalise(asked[r["i"]], YEARS, method)[0])
            except ValueError:
                want = None
            assert r["it"] == want


def area_of(points):
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]], strict=True)) / 2


def star(rng, n, cx, cy, low, high):
    """A polygon, concave as a rule, around a point."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in angles for r in [rng.uniform(low, high)]]


def inside(rings, x, y):
    return sum((y0 > y) != (y1 > y) and x < x0 + (x1 - x0) * (y - y0) / (y1 - y0) for r in rings for (x0, y0), (x1, y1) in zip(r, [*r[1:], r[0]], strict=True)) % 2 == 1


def test_convex_parts_cover_a_polygon(spark):
    rng = random.Random(11)
    for n in (3, 4, 7, 30, 200):
        rings = [star(rng, n, 0, 0, 5, 9), star(rng, n, 0, 0, 1, 3), star(rng, n, 30, 2, 1, 5)]
        if n < 7:  # these need not be around the point: no hole
            rings = rings[::2]
        parts = geom.convex_parts(rings)
        for p in parts:  # trapezoids: two heights, and left before right at both, but for rounding
            assert len({y for _, y in p}) == 2 and all(b[0] - a[0] > -1e-9 for a, b in zip(p, p[1:], strict=False) if a[1] == b[1] == min(y for _, y in p))
        want = sum(abs(area_of(r)) * (-1 if len(rings) == 3 and i == 1 else 1) for i, r in enumerate(rings))
        assert sum(abs(area_of(p)) for p in parts) == pytest.approx(want)
        for _ in range(200):
            x, y = rng.uniform(-10, 36), rng.uniform(-10, 10)
            assert inside(rings, x, y) == any(inside([p], x, y) for p in parts)
    boxes = [(i, x, y, x + rng.uniform(0.1, 4), y + rng.uniform(0.1, 4)) for i in range(300) for x, y in [(rng.uniform(-10, 36), rng.uniform(-10, 10))]]
    df = spark.createDataFrame(boxes, "id int, a double, b double, c double, d double")
    got = {r["id"] for r in df.filter(geom.any_meets(parts, geom.box_ring(F.col("a"), F.col("b"), F.col("c"), F.col("d")))).collect()}
    for i, a, b, c, d in boxes:
        if any(inside(rings, a + (c - a) * (u + 0.5) / 12, b + (d - b) * (v + 0.5) / 12) for u in range(12) for v in range(12)):
            assert i in got
        elif i in got:  # only a sliver: its box parts must truly overlap
            assert any(min(p[0] for p in q) < c and max(p[0] for p in q) > a and min(p[1] for p in q) < d and max(p[1] for p in q) > b for q in parts)
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert geom.convex_parts([square]) == [square] and geom.convex_parts([]) == []
    table = geom.with_parts(spark.createDataFrame([([rings[0]],), (None,)], geom.PARTS.replace("array<array", "rings array<array", 1)), "rings", "parts").collect()
    assert len(table[0]["parts"]) == len(geom.convex_parts(rings[:1])) and table[1]["parts"] is None

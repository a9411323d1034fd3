"""The store, cubes and sources, end to end."""

import json
import logging
import os
import random
import threading

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cubespark.functions import crs, geom
from cubespark.functions.grid import GridSpec
from cubespark.plans.cube import Area, Areas, Cube
from cubespark.plans.definitions import Channel, CubeDef
from cubespark.plans.store import ConflictError, NotCreatedError, Store
from cubespark.sources import items, python_source
from cubespark.sources.base import Events, SourceError, TileSource, fetched
from cubespark.streaming.ingest import ingest_stream

GRID = GridSpec(0.0, 20.0, 1.0, 20, 20, 3857)
PLAIN = CubeDef("plain", "Plain", GRID, 5, (Channel("v", "float64", {"units": "m"}), Channel("ok", "bool")))
TIMED = CubeDef("timed", "Timed", GRID, 5, (Channel("v", "float32"),), tuple(f"{y}-01-01" for y in range(2017, 2025)))


def fetch(row):
    r, c = (int(x) for x in row["patch_id"].split("-")[-2:])
    at = [(iy, ix) for iy in range(5 * r, 5 * r + 5) for ix in range(5 * c, 5 * c + 5)]
    n = len(at)
    it = row.get("it")
    out = {"it": pa.array([it] * n, pa.int32()), "iy": pa.array([a for a, _ in at], pa.int32()), "ix": pa.array([b for _, b in at], pa.int32())}
    out["v"] = pa.array([100.0 * a + b + 10_000 * (it or 0) for a, b in at])
    return pa.table(out | {"ok": pa.array([True] * n)})


def area(left, bottom, right, top):
    return Area.box((left, bottom, right, top), 3857)


@pytest.fixture
def cube(spark, tmp_path):
    c = Cube(spark, str(tmp_path / "cube"), PLAIN, TileSource(fetch))
    c.create()
    return c


def test_create(spark, tmp_path):
    c = Cube(spark, str(tmp_path / "c"), PLAIN)
    assert not c.created
    with pytest.raises(NotCreatedError):
        c.load(area(0, 0, 1, 1))
    c.create()
    assert c.created and c.store.loaded_patches() == [] and c.current_state() is None
    assert c.open().count() == 0
    with pytest.raises(FileExistsError):
        c.create()
    c.create(exists_ok=True, overwrite=True)  # exists_ok wins
    c.store.commit(["x"], "none")
    c.create(overwrite=True)
    assert c.store.snapshot() == 0
    assert Cube(spark, str(tmp_path / "c")).definition == PLAIN
    assert "plain" in repr(c)


def test_hooks_are_called(spark, tmp_path):
    class Own(Cube):
        def post_init(self):
            self.called = ["init"]

        def post_create(self):
            self.called.append("create" if self.created else "too early")

    c = Own(spark, str(tmp_path / "c"), PLAIN)
    assert c.called == ["init"]
    c.create()
    assert c.called == ["init", "create"]


def test_load_is_the_source_window(cube):
    out = cube.load(area(3.5, 11.2, 7.0, 13.0))
    got = {(r["iy"], r["ix"]): (r["v"], r["x"], r["y"]) for r in out.collect()}
    assert set(got) == {(iy, ix) for iy in range(7, 9) for ix in range(3, 7)}
    assert got[(7, 3)] == (703.0, 3.5, 12.5)
    assert cube.store.loaded_patches() == ["1-0", "1-1"]
    assert out.schema["v"].metadata == {"units": "m"}
    out.unpersist()


def test_ingest_is_idempotent_and_incremental(cube):
    assert cube.ingest(area(0, 15, 5, 20)) == ["0-0"]
    assert cube.ingest(area(0, 15, 5, 20)) == []
    assert cube.ingest(area(0, 15, 6, 20)) == ["0-1"]
    assert cube.open().count() == 50
    state = cube.current_state().collect()
    assert sorted(r["id"] for r in state) == ["0-0", "0-1"] and {r["epsg"] for r in state} == {3857}
    with pytest.raises(ValueError):
        cube.ingest(area(100, 100, 101, 101))


def test_snapshots_are_stable(cube):
    cube.ingest(area(0, 15, 5, 20))
    first = cube.store.snapshot()
    cube.ingest(area(5, 15, 10, 20))
    whole = area(0, 0, 20, 20)
    assert cube.load(whole, snapshot=first, persist=False).count() == 25
    assert cube.load(whole, snapshot=cube.store.snapshot(), persist=False).count() == 50


def test_fill_and_channels(cube):
    cube.ingest(area(0, 15, 5, 20))
    out = cube.load(area(0, 10, 10, 20), snapshot=1, fill=0, channels=["ok"], persist=False)
    rows = out.collect()
    assert len(rows) == 100 and "v" not in out.columns and sum(r["ok"] for r in rows) == 25


def test_fill_reaches_steps_without_cells(spark, tmp_path):
    c = Cube(spark, str(tmp_path / "t"), TIMED, TileSource(fetch))
    c.create()
    c.ingest(area(0, 15, 5, 20), "2018-01-01")
    out = c.load(area(0, 15, 2, 16), ["2017-01-01", "2018-01-01"], snapshot=1, fill=-1, persist=False)
    assert {(r["it"], r["ix"], r["v"]) for r in out.collect()} == {(0, 0, -1.0), (0, 1, -1.0), (1, 0, 10400.0), (1, 1, 10401.0)}
    assert c.load(area(0, 15, 1, 16), snapshot=1, fill=-1, persist=False).count() == 8


def test_load_like_with_buffer(spark, cube):
    like = spark.createDataFrame([(2.5, 17.5), (3.5, 16.5)], "x double, y double")
    got = {(r["iy"], r["ix"]) for r in cube.load_like(like, buffer=1, persist=False).collect()}
    assert got == {(iy, ix) for iy in range(1, 5) for ix in range(1, 5)}


U_SHAPE = ((1.0, 1.0), (19.0, 1.0), (19.0, 19.0), (16.0, 19.0), (16.0, 4.0), (4.0, 4.0), (4.0, 19.0), (1.0, 19.0))


def test_concave_areas_and_holes(cube):
    sides = [f"{r}-{c}" for r in range(4) for c in range(4) if c in (0, 3) or r == 3]
    assert sorted(cube.ingest(Area(U_SHAPE, 3857))) == sides
    frame = {"type": "Polygon", "coordinates": [[[1, 1], [19, 1], [19, 19], [1, 19], [1, 1]], [[5, 5], [15, 5], [15, 15], [5, 15], [5, 5]]]}
    assert sorted(cube.ingest(Area.geojson(frame, 3857))) == ["0-1", "0-2"]
    both = {"type": "MultiPolygon", "coordinates": [[[[6, 11], [9, 11], [9, 14], [6, 11]]], [[[11, 6], [14, 6], [14, 9], [11, 6]]]]}
    assert sorted(cube.ingest(Area.geojson(both, 3857))) == ["1-1", "2-2"]
    assert cube.load(Area.geojson(both, 3857), persist=False).count() == 32  # 4 x 4 pixels of either patch are in the window


def test_tables_of_areas(spark, cube):
    boxes = spark.createDataFrame([(1.0, 16.0, 2.0, 17.0), (1.5, 16.5, 6.0, 17.0), (16.0, 1.0, 17.0, 2.0)], "x_min double, y_min double, x_max double, y_max double")
    areas = Areas.of_boxes(boxes, 3857)
    assert sorted(cube.ingest(areas)) == ["0-0", "0-1", "3-3"]
    assert cube.load(areas, persist=False).count() == 2 * 4 + 2 * 5 + 4 * 2 and cube.store.loaded_patches() == ["0-0", "0-1", "3-3"]
    rings = spark.createDataFrame([([[(x, y) for x, y in U_SHAPE]],)], "rings array<array<struct<x:double,y:double>>>")
    assert len(cube.ingest(Areas(rings, 3857))) == 8
    lonlat = Areas(rings.selectExpr("transform(rings, r -> transform(r, p -> named_struct('x', p.x / 111319.49079327358, 'y', p.y / 111319.49079327358))) AS rings"))
    assert cube.ingest(lonlat) == []
    with pytest.raises(ValueError):
        cube.ingest(Areas(rings.limit(0), 3857))


def test_small_chunks_share_folders(spark, tmp_path, monkeypatch):
    from cubespark.plans import store as stores

    def load(c, box):
        files = c.store.raw(ordered=False, window=c.window(area(*box))).select(F.input_file_name()).distinct().collect()
        return sorted((r["iy"], r["ix"], r["v"]) for r in c.load(area(*box), persist=False).collect()), {"/".join(r[0].split("/")[-3:-1]) for r in files}

    def folders(c):
        return {at for at, _, files in os.walk(f"{c.store.path}/data") if any(f.endswith(".parquet") for f in files)}

    cube = Cube(spark, str(tmp_path / "one"), PLAIN, TileSource(fetch))
    cube.create()
    cube.ingest(area(0, 0, 20, 20))
    assert len(folders(cube)) == 1 and len(load(cube, (0, 0, 20, 20))[0]) == 400
    # Fragments of several layouts in one store; what a window does not meet is not read.
    cube = Cube(spark, str(tmp_path / "all"), PLAIN, TileSource(fetch))
    cube.create()
    for edge, box in ((1, (0, 0, 20, 4)), (10, (0, 6, 20, 20)), (1024, (0, 0, 20, 20))):
        monkeypatch.setattr(stores, "BLOCK", edge, raising=False)
        cube.ingest(area(*box))
    assert len(cube.store.manifest().collect()) == 16
    for box in ((0, 0, 20, 20), (2, 3, 9, 18), (11, 11, 19, 19)):
        want = sorted((iy, ix, 100.0 * iy + ix) for iy in range(20 - box[3], 20 - box[1]) for ix in range(box[0], box[2]))
        got, read = load(cube, box)
        assert got == want
    assert "block_y=0/block_x=1" in read and "block_y=1/block_x=0" not in read  # of the second layout, 10 pixels a folder
    cube.store.compact()
    assert load(cube, (0, 0, 20, 20))[0] == sorted((iy, ix, 100.0 * iy + ix) for iy in range(20) for ix in range(20))


def test_areas_that_repeat_are_cut_once(spark):
    boxes = spark.range(60).selectExpr("double(id % 2) AS x_min", "0D AS y_min", "double(id % 2 + 1) AS x_max", "1D AS y_max")
    boxed = Areas.of_boxes(boxes, 3857).boxed()
    assert sorted((r["x_min"], r["x_max"], len(r["parts"])) for r in boxed.collect()) == [(0.0, 1.0, 1), (1.0, 2.0, 1)]


def test_convex_rings_are_told_without_python(spark):
    rng = random.Random(4)
    rings = [[(float(rng.randint(0, 3)), float(rng.randint(0, 3))) for _ in range(n)] for n in (3, 4, 4, 5, 6) for _ in range(60)]
    star = [(0.0, 3.0), (2.0, -3.0), (-3.0, 1.0), (3.0, 1.0), (-2.0, -3.0)]
    lists = [[r] for r in [*rings, star, list(U_SHAPE)]] + [[[(0.0, 0.0), (1.0, 0.0)]], [rings[0], rings[1]], []]
    kind = "rings array<array<struct<x:double,y:double>>>"
    out = geom.with_parts(spark.createDataFrame([(r,) for r in lists], kind), "rings", "parts").withColumn("one", geom.one_convex(F.col("rings"))).collect()
    points = lambda found: [[(p["x"], p["y"]) for p in r] for r in found]
    assert len(out) == len(lists) and {r["one"] for r in out} == {True, False}
    for row in out:
        given = points(row["rings"])
        assert row["one"] == (len(given) == 1 and geom.is_convex(given[0])) and points(row["parts"]) == geom.convex_parts(given)


def test_the_log_of_an_ingest(cube, caplog):
    with caplog.at_level(logging.INFO):
        cube.ingest(area(0, 15, 6, 20))
        assert cube.stats() == {"name": "plain", "cells": 400, "channels": 2, "bytes": 3600, "patches": 2, "commits": 1}
    assert "2 patches committed" in caplog.text and "400 cells" in caplog.text
    got = sorted((r["action"], r["patch_id"]) for r in cube.event_log().collect())
    assert got == sorted((a, p) for p in ("0-0", "0-1") for a in ("start_download_try0", "end_download_try0", "start_write", "end_write"))


def test_time_on_a_plain_cube(cube):
    with pytest.raises(ValueError):
        cube.load(area(0, 0, 1, 1), "2020-01-01")


def test_timed_cube(spark, tmp_path):
    c = Cube(spark, str(tmp_path / "t"), TIMED, TileSource(fetch))
    c.create()
    out = c.load(area(0, 15, 5, 20), ["2018-03-01", "2019-10-01"], persist=False)
    assert {(r["it"], str(r["time"])[:4]) for r in out.collect()} == {(1, "2018"), (3, "2020")}
    assert c.store.loaded_patches() == ["1-0-0", "3-0-0"]
    assert c.load(area(0, 15, 5, 20), slice("2018-01-01", "2019-01-01"), persist=False).count() == 50
    assert c.store.loaded_patches() == ["1-0-0", "3-0-0", "2-0-0"]
    assert c.load(area(0, 15, 5, 20), persist=False).count() == 200
    like = c.load(area(0, 15, 2, 20), pd.DatetimeIndex(["2018-01-01"]), persist=False)
    assert {r["it"] for r in c.load_like(like, persist=False).collect()} == {1}
    assert {str(r["time"])[:4] for r in c.current_state().collect()} == {str(y) for y in range(2017, 2025)}


def fragment(spark, store, patch, value, cells=((0, 0), (1, 1))):
    rows = [(patch, None, iy, ix, value, True) for iy, ix in cells]
    return store.write_fragment(spark.createDataFrame(rows, "patch_id string, it int, iy int, ix int, v double, ok boolean"))


def test_last_valid_value_wins_and_compaction_keeps_it(spark, cube):
    s = cube.store
    s.commit(["a"], fragment(spark, s, "a", 1.0))
    s.commit(["b"], fragment(spark, s, "b", 2.0, [(0, 0)]))
    s.commit(["c"], fragment(spark, s, "c", float("nan"), [(0, 0), (1, 1)]))
    fragment(spark, s, "d", 9.0)  # never committed
    read = lambda n=None: {(r["iy"], r["ix"]): r["v"] for r in cube.open(n).collect()}
    assert read() == {(0, 0): 2.0, (1, 1): 1.0}
    s.compact()
    assert read() == {(0, 0): 2.0, (1, 1): 1.0} and read(1) == {(0, 0): 1.0, (1, 1): 1.0}
    s.commit(["e"], fragment(spark, s, "e", 5.0, [(1, 1)]))
    assert read() == {(0, 0): 2.0, (1, 1): 5.0}


def scanned(df):
    """Cells that the scan of the data read."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            node = node.plan()
        if "Scan parquet" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return sum(out)


def test_compaction_bounds_what_is_read(spark, cube):
    s = cube.store
    for i in range(5):
        s.commit([f"p{i}"], fragment(spark, s, f"p{i}", float(i)))
    before = cube.open()
    assert scanned(before) == 10
    s.compact()
    after = cube.open()
    assert scanned(after) == 2 and sorted(map(tuple, after.collect())) == sorted(map(tuple, before.collect()))
    assert cube.open(3).count() == 2 and {r["v"] for r in cube.open(3).collect()} == {2.0}
    assert s.loaded_patches() == [f"p{i}" for i in range(5)]
    s.compact()
    assert scanned(cube.open()) == 2


def test_commits_during_a_compaction_win(spark, cube, monkeypatch):
    s, other = cube.store, Store(spark, cube.store.path)
    s.commit(["a"], fragment(spark, s, "a", 1.0))
    real, raced = s.write_fragment, []

    def slow(c):
        out = real(c)
        if not raced:
            raced.append(other.commit(["b"], fragment(spark, other, "b", 2.0, [(0, 0)])))
        return out

    monkeypatch.setattr(s, "write_fragment", slow)
    s.compact()
    read = lambda n=None: {(r["iy"], r["ix"]): r["v"] for r in cube.open(n).collect()}
    assert read() == read(2) == {(0, 0): 2.0, (1, 1): 1.0} and read(1) == {(0, 0): 1.0, (1, 1): 1.0}


def test_the_compaction_that_stands_for_more_is_read(spark, cube):
    s = cube.store
    s.commit(["a"], fragment(spark, s, "a", 1.0))
    s.commit(["b"], fragment(spark, s, "b", 2.0))
    s.commit(["compacted"], fragment(spark, s, "compacted", 2.0), replaces=2)
    s.commit(["compacted"], fragment(spark, s, "compacted", 1.0), replaces=1)  # began before, ended after
    s.commit(["c"], fragment(spark, s, "c", 3.0, [(1, 1)]))
    assert {(r["iy"], r["ix"]): r["v"] for r in cube.open().collect()} == {(0, 0): 2.0, (1, 1): 3.0}


def test_vacuum_leaves_what_commits_name(spark, cube):
    s = cube.store
    s.commit(["a"], fragment(spark, s, "a", 1.0))
    lost = fragment(spark, s, "b", 9.0)
    assert s.vacuum() == [] and s.vacuum(hours=-1) == [lost]
    assert cube.open().count() == 2


def test_two_writers(spark, cube):
    s = cube.store
    f = fragment(spark, s, "a", 1.0)
    base = s.snapshot()
    assert s.commit(["a"], f, base=base) == 1
    with pytest.raises(ConflictError):
        s.commit(["b"], f, base=base)


def test_a_lost_race_is_tried_again(spark, cube, monkeypatch):
    s, other = cube.store, Store(spark, cube.store.path)
    cells = fetched(spark.createDataFrame([("0-0",), ("0-1",)], "patch_id string"), fetch, PLAIN.cell_schema())
    real, raced = s.write_fragment, []

    def slow(c):
        out = real(c)
        if not raced:
            raced.append(other.commit(["0-0"], real(c.filter("patch_id = '0-0'"))))
        return out

    monkeypatch.setattr(s, "write_fragment", slow)
    assert s.write_patches(spark.createDataFrame([("0-0",), ("0-1",)], "patch_id string"), cells) == ["0-1"]
    assert s.loaded_patches() == ["0-0", "0-1"] and cube.open().count() == 50
    assert cube.load(area(0, 15, 10, 20), persist=False, overlaps=False).count() == 50


def test_overlapping_areas_in_threads(cube):
    errors = []

    def run(left):
        try:
            cube.load(area(left, 12, left + 6, 18), persist=False).count()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(x,)) for x in (0, 3, 6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    held = cube.store.loaded_patches()
    assert len(held) == len(set(held)) == 6


def test_out_of_range_values_are_refused(spark, tmp_path):
    d = CubeDef("byte", "Byte", GRID, 5, (Channel("b", "uint8"),))
    c = Cube(spark, str(tmp_path / "b"), d)
    c.create()
    bad = spark.createDataFrame([("a", None, 0, 0, 300)], "patch_id string, it int, iy int, ix int, b int")
    with pytest.raises(Exception, match="out of range"):
        c.store.write_fragment(bad)


def test_flaky_fetches(spark, tmp_path):
    patches = spark.createDataFrame([("0-0",)], "patch_id string")
    state = str(tmp_path)

    def flaky(times):
        def f(row):
            import os

            n = len(os.listdir(state))
            open(f"{state}/{n}", "w").close()
            if n < times:
                raise OSError("not now")
            return fetch(row)

        return f

    assert fetched(patches, flaky(4), PLAIN.cell_schema()).count() == 25

    def never(row):
        raise OSError("never")

    with pytest.raises(Exception, match="no success in 5 tries"):
        fetched(patches, never, PLAIN.cell_schema()).count()
    [os.remove(f"{state}/{f}") for f in os.listdir(state)]
    log = spark.sparkContext.accumulator([], Events())
    assert fetched(patches, flaky(1), PLAIN.cell_schema(), log=log).count() == 25
    assert [e[0] for e in log.value] == ["start_download_try0", "start_download_try1", "end_download_try1"]
    assert issubclass(SourceError, Exception)


FEATURES = {
    "type": "FeatureCollection",
    "features": [
        {"id": f"i{i}", "collection": c, "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 1], [i, 1], [i, 0]]]}, "properties": p, "assets": {"dem": {"href": f"file:{i}"}}}
        for i, (c, p) in enumerate(
            [
                ("a", {"datetime": "2020-01-05T00:00:00Z"}),
                ("a", {"datetime": None, "start_datetime": "2020-01-01T00:00:00Z", "end_datetime": "2020-03-01T00:00:00Z"}),
                ("a", {"datetime": "2020-02-01T00:00:00Z", "start_datetime": "2019-01-01T00:00:00Z", "end_datetime": "2021-01-01T00:00:00Z"}),
                ("a", {}),
                ("b", {"datetime": "2020-01-05T00:00:00Z"}),
            ]
        )
    ],
}


def test_items(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps(FEATURES))
    source = items.ItemSource(items.read_features(spark, str(tmp_path / "f.json")), fetch, "a")
    ids = lambda df: sorted(r["patch_id"] for r in df.collect())
    assert ids(source.search()) == ["i0", "i1", "i2", "i3"]
    assert ids(source.search(when="2020-01-05")) == ["i0", "i1"]
    assert ids(source.search(when=slice("2020-01-20", "2020-02-10"))) == ["i1", "i2"]
    assert ids(source.search(Area.box((0.5, 0.2, 1.5, 0.8)))) == ["i0", "i1"]
    assert ids(source.search(ids=spark.createDataFrame([("i3",), ("zz",)], "id string"))) == ["i3"]
    r = source.search().filter("patch_id = 'i0'").first()
    assert (r["x_min"], r["x_max"], len(r["geometry"]), r["item"]["dem"]) == (0.0, 1.0, 4, "file:0")


def test_index_source(spark, tmp_path):
    box = GRID.tiles(spark, 5).select(F.concat_ws("-", "row", "col").alias("id"), "x_min", "y_min", "x_max", "y_max")
    from cubespark.functions import geom

    path, made = str(tmp_path / "index"), []

    def ensure():
        made.append(1)
        box.withColumn("geometry", geom.box_ring(*[F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")])).write.parquet(path)

    source = items.IndexSource(path, fetch, lambda i: F.concat(F.lit("https://example.org/"), i), ensure)
    c = Cube(spark, str(tmp_path / "cube"), PLAIN, source)
    with pytest.raises(NotCreatedError):
        c.ingest(area(0, 0, 4, 4))
    c.create()
    assert c.ingest(area(0, 0, 4, 4)) == ["3-0"]
    assert made == [1]
    assert [r["id"] for r in c.current_state().collect()] == ["3-0"]
    assert source.patches(c, area(0, 0, 4, 4), None, None).first()["item"] == {"url": "https://example.org/3-0"}


def test_unpack(tmp_path, monkeypatch):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("deep/a.parquet", "new")
        z.writestr("deep/er/b.parquet", "b")
        z.writestr("readme.txt", "no")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.parquet").write_text("old")
    assert len(items.unpack(str(tmp_path / "x.zip"), str(tmp_path / "out"))) == 2
    assert (tmp_path / "out" / "a.parquet").read_text() == "old" and (tmp_path / "out" / "b.parquet").read_text() == "b"
    monkeypatch.setenv("CUBESPARK_AUX", "/elsewhere")
    assert items.aux_dir("here") == "/elsewhere"
    calls = []
    read = items.remembered(lambda u: calls.append(u) or u)
    assert read("u") == read("u") and calls == ["u"]


def test_python_source_prunes_partitions(spark):
    python_source.register(spark)
    ids = [{"patch_id": f"0-{c}"} for c in range(4)]
    scan = spark.read.format("cube_patches").options(patches=json.dumps(ids), fetch="cubespark.plans.catalogue:sample_patch", channels="v double").load()
    assert scan.count() == 100
    one = scan.filter("patch_id = '0-2'")
    assert one.count() == 25 and one.rdd.getNumPartitions() == 1
    assert scan.filter("patch_id = 'none'").count() == 0


def test_stream(spark, tmp_path):
    c = Cube(spark, str(tmp_path / "cube"), PLAIN)
    c.create()
    cells = fetched(spark.createDataFrame([("0-0",), ("0-1",), ("2-2",)], "patch_id string"), fetch, PLAIN.cell_schema())
    cells.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(c, str(tmp_path / "in"), str(tmp_path / "log"), files_per_batch=1).awaitTermination()
    assert sorted(c.store.loaded_patches()) == ["0-0", "0-1", "2-2"] and c.open().count() == 75
    cells.write.mode("append").parquet(str(tmp_path / "in"))  # the same patches in other files
    ingest_stream(c, str(tmp_path / "in"), str(tmp_path / "log")).awaitTermination()
    assert c.open().count() == 75


def test_area_in_degrees(cube):
    lon, lat = crs.from_mercator(7.5, 7.5, crs.NUMBERS)
    assert cube.ingest((lon - 1e-6, lat - 1e-6, lon + 1e-6, lat + 1e-6)) == ["2-1"]
    with pytest.raises(TypeError):
        Area.of("nowhere")


class Canvas:
    """Records what is drawn."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        return lambda *a, **k: self.calls.append((name, a))


def test_drawings(spark, cube):
    with pytest.raises(ValueError):
        cube.visualize_state(Canvas())
    cube.ingest(area(0, 15, 6, 20))
    drawn = cube.visualize_state(Canvas()).calls
    assert [c[0] for c in drawn] == ["fill", "fill"] and len(drawn[0][1][0]) == 5
    from cubespark.operators import telemetry
    from cubespark.plans import plots

    rows = [(f"{s}_get_try0", "p", t, 1, "w1") for s, t in (("start", 0), ("end", 3))]
    log = spark.createDataFrame(rows, "action string, patch_id string, s int, thread_id long, thread_name string").withColumn("time", F.timestamp_seconds("s"))
    bars = [c for c in plots.worker_chart(telemetry.timeline(telemetry.event_pairs(log.drop("s"))), Canvas()).calls if c[0] == "barh"]
    assert bars == [("barh", (0, 3.0))]
    with pytest.raises(ValueError):
        plots.state_map(cube.current_state(), Canvas(), most=1)

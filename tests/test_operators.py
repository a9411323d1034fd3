import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cubespark.functions.grid import Window
from cubespark.operators import cells as ops
from cubespark.operators import mosaic, pruning, telemetry

NAN = float("nan")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlay_keeps_what_a_patch_lacks(spark):
    cube = spark.createDataFrame([(x, y, 1.0) for x in range(3) for y in range(3)], "ix int, iy int, v double")
    patch = spark.createDataFrame([(x, y, NAN if (x, y) == (1, 1) else 2.0) for x in range(1, 4) for y in range(1, 4)], "ix int, iy int, v double")
    got = {(r["ix"], r["iy"]): r["v"] for r in mosaic.overlay(cube, patch, ["v"]).collect()}
    assert len(got) == 9 + 9 - 4
    assert got[(1, 1)] == 1.0 and got[(2, 2)] == 2.0 and got[(0, 0)] == 1.0 and got[(3, 3)] == 2.0
    only_nan = mosaic.overlay(cube.limit(0), patch, ["v"]).collect()
    assert next(r["v"] for r in only_nan if (r["ix"], r["iy"]) == (1, 1)) is None


def test_mosaics(spark):
    df = spark.createDataFrame([(0, 0, 1, 5.0, True), (0, 0, 2, NAN, False), (0, 0, 3, 4.0, None), (1, 0, 1, NAN, None)], "ix int, iy int, o int, v double, b boolean")
    top = {(r["ix"]): (r["v"], r["b"]) for r in mosaic.mosaic_last(df, ["v", "b"], ["o"]).collect()}
    assert top == {0: (4.0, False), 1: (None, None)}
    assert {r["ix"]: (r["v"], r["b"]) for r in mosaic.mosaic_max(df, ["v", "b"]).collect()} == {0: (5.0, True), 1: (None, None)}


def test_gap_fill_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for p in "ab":
        for x in range(30):
            for y in range(30):
                hole = rng.random() < 0.3 or (4 < x < 22 and 4 < y < 22)
                rows.append((p, x, y, NAN if hole else float(rng.randint(0, 255))))
    df = spark.createDataFrame(rows, "patch_id string, ix int, iy int, v double")
    valid = {p: [(x, y, v) for q, x, y, v in rows if q == p and v == v] for p in "ab"}
    want = {}
    for p, x, y, v in rows:
        want[(p, x, y)] = v if v == v else min(((a - x) ** 2 + (b - y) ** 2, b, a, w) for a, b, w in valid[p])[3]
    got = {(r["patch_id"], r["ix"], r["iy"]): r["v"] for r in mosaic.fill_gaps(df, "v", ["patch_id"]).collect()}
    assert got == want


def test_a_patch_without_values_stays_empty(spark):
    df = spark.createDataFrame([("a", 0, 0, NAN), ("a", 1, 0, None)], "patch_id string, ix int, iy int, v double")
    assert [r["v"] for r in mosaic.fill_gaps(df, "v", ["patch_id"]).collect()] == [None, None]


def test_far_gaps_are_filled(spark):
    df = spark.createDataFrame([("a", 0, 0, 7.0), ("a", 100_000, 3, NAN)], "patch_id string, ix int, iy int, v double")
    assert [r["v"] for r in mosaic.fill_gaps(df, "v", ["patch_id"]).collect()] == [7.0, 7.0]


@pytest.mark.parametrize("name", ["gap_fill_nearest", "byte_bands"])
def test_cells_of_all_rows_are_filled(spark, tmp_path, name):
    from cubespark.plans.catalogue import ORACLE_SQL, QUERIES

    rng = random.Random(2)
    vectors = [(i, [rng.uniform(-3, 3) for _ in range(64)]) for i in range(700)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(x, y): v for x, y, v in duck.execute(f"SELECT ix, iy, v FROM ({ORACLE_SQL[name]})").fetchall()}
    got = {(r["ix"], r["iy"]): r["v"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want) and len(got) == 700


def test_crop_prunes_chunks(spark, tmp_path):
    df = ops.with_chunks(spark.range(2500).select((F.col("id") % 50).cast("int").alias("ix"), (F.col("id") / 50).cast("int").alias("iy"), F.col("id").alias("v"), F.col("id").alias("w")), 10)
    df.write.partitionBy("chunk_y", "chunk_x").parquet(str(tmp_path / "c"))
    out = ops.crop(spark.read.parquet(str(tmp_path / "c")), Window(12, 18, 33, 37), 10).select("v")
    assert out.count() == 24
    p = plan(out)
    filters = p[p.index("PartitionFilters") :].split("]")[0]
    assert "chunk_x" in filters and "chunk_y" in filters and "w:" not in p[p.index("ReadSchema") :]
    assert "PushedFilters: [" in p and "GreaterThanOrEqual(ix,12)" in p


def test_spatial_join_has_no_nested_loop(spark):
    rng = random.Random(2)
    box = lambda i: (i, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.uniform(0.01, 9), y + rng.uniform(0.01, 9))
    a, b = [box(i) for i in range(200)], [box(i) for i in range(150)]
    names = "id int, x_min double, y_min double, x_max double, y_max double"
    j = pruning.spatial_join(spark.createDataFrame(a, names), spark.createDataFrame(b, names), 2.5).select("t.id", F.col("a.id").alias("other"))
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4])
    assert sorted(map(tuple, j.collect())) == want
    assert "NestedLoop" not in plan(j) and "Cartesian" not in plan(j)


def test_interval_join_has_each_pair_once(spark):
    rng = random.Random(3)
    span = lambda i: (i, f"2020-01-01 00:00:00 + {i}", (d := rng.randint(0, 900)), d + rng.randint(0, 200))
    a, b = [span(i) for i in range(80)], [span(i) for i in range(60)]
    at = lambda c: F.expr(f"timestamp_ntz '2020-01-01' + make_dt_interval({c})")
    frame = lambda rows: spark.createDataFrame([(i, x, y) for i, _, x, y in rows], "id int, x int, y int").select("id", at("x").alias("t0"), at("y").alias("t1"))
    j = pruning.interval_join(frame(a), frame(b)).select("i.id", F.col("r.id").alias("other"))
    want = sorted((p[0], q[0]) for p in a for q in b if p[2] <= q[3] and q[2] <= p[3])
    assert sorted(map(tuple, j.collect())) == want
    assert "NestedLoop" not in plan(j)


@pytest.mark.parametrize("unit", ["secs", "days"])
def test_interval_join_of_equal_intervals_and_full_bins(spark, monkeypatch, unit):
    monkeypatch.setattr(pruning, "TOGETHER", 3, raising=False)
    rng = random.Random(5)
    a = [(i, (d := rng.randint(-40, 40)), d + rng.randint(-1, 6)) for i in range(90)] + [(90, None, 4), (91, -2000, 2000)]
    b = [(i, (d := rng.choice([-7, 0, 7])), d + 2) for i in range(200)] + [(200, 3, None), (201, 5, 4), (202, -39, -39)]
    at = lambda c: F.expr(f"timestamp_ntz '1970-01-01' + make_dt_interval({'0, 0, 0, ' * (unit == 'secs')}{c})")
    frame = lambda rows: spark.createDataFrame(rows, "id int, x int, y int").select("id", at("x").alias("t0"), at("y").alias("t1"), F.create_map("id", "x").alias("m"))
    want = sorted((p[0], q[0]) for p in a for q in b if None not in (*p, *q) and p[1] <= p[2] and q[1] <= q[2] and p[1] <= q[2] and q[1] <= p[2])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = pruning.interval_join(frame(a), frame(b)).select("i.id", F.col("r.id").alias("other"))
        assert sorted(map(tuple, j.collect())) == want and "NestedLoop" not in plan(j)
        p = plan(j)
        assert p.index("Generate explode") < p.index("Join")  # requests of one interval become pairs after the join
        hot = pruning.interval_join(frame([(i, 0, 5) for i in range(64)]), frame([(i, 1, 2) for i in range(40)]), days=31)
        tasks = hot.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == 64 * 40 and len(tasks) > 1  # all of them in one bin
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_missing_keeps_repeated_patches(spark):
    p = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "patch_id string")
    m = spark.createDataFrame([("b",), ("b",), (None,)], "patch_id string")
    assert sorted(r[0] for r in pruning.missing(p, m).collect()) == ["a", "a", "c"]


def test_densify(spark):
    df = spark.createDataFrame([(0, 1, 1, 5.0, 7), (1, 0, 0, NAN, None)], "it int, ix int, iy int, v double, n int")
    out = {(r["it"], r["ix"], r["iy"]): (r["v"], r["n"]) for r in ops.densify(df, Window(0, 2, 0, 2), ["v", "n"], 0, spark.range(2).selectExpr("CAST(id AS int) AS it")).collect()}
    assert len(out) == 8 and out[(0, 1, 1)] == (5.0, 7) and out[(1, 0, 0)] == (0.0, 0) and out[(0, 0, 0)] == (0.0, 0)


def test_clip_then_cast(spark):
    v = [r[0] for r in spark.createDataFrame([(-5.0,), (12.9,), (300.0,)], "v double").select(ops.clip_cast(F.col("v"), F.lit(0.0), F.lit(255.0))).collect()]
    assert v == [0, 12, 255]


@pytest.fixture
def events(spark):
    rows = [
        ("start_download_try1", "p1", "2024-01-01 00:00:00", 1, "w1"), ("end_download_try1", "p1", "2024-01-01 00:00:02", 1, "w1"),
        ("start_download_try1", "p1", "2024-01-01 00:00:10", 1, "w1"), ("end_download_try1", "p1", "2024-01-01 00:00:13", 1, "w1"),
        ("start_write", "p1", "2024-01-01 00:01:00", 2, "w0"), ("end_write", "p1", "2024-01-01 00:01:01.5", 2, "w0"),
        ("start_write", "p2", "2024-01-01 00:02:00", 2, "w0"),
    ]
    return spark.createDataFrame(rows, "action string, patch_id string, t string, thread_id long, thread_name string").withColumn("time", F.col("t").cast("timestamp_ntz")).drop("t")


def test_event_pairs(events):
    pairs = telemetry.event_pairs(events)
    assert pairs.count() == 5  # two starts with two ends, and one write; the unfinished one is left out
    assert sorted(r["duration"] for r in telemetry.event_pairs(events, ordinal=True).collect()) == [1.5, 2.0, 3.0]
    lanes = {(r["action"], r["lane"]) for r in telemetry.timeline(pairs).collect()}
    assert lanes == {("download", 1), ("write", 0)}
    s = {r["action"]: (r["n"], r["total"]) for r in telemetry.section_summary(telemetry.event_pairs(events, ordinal=True)).collect()}
    assert s == {"download_try1": (2, 5.0), "write": (1, 1.5)}

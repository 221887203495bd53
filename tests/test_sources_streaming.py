import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.box import Box
from cellweave.functions import bin_id, min_image, morton, wrap
from cellweave.operators import physics, shapes
from cellweave.operators.moving import Moving
from cellweave.operators.tessellate import tessellate
from cellweave.operators.walls import HalfSpace, Sphere, wall_force, spheres_distance
from cellweave.operators.tessellate import build_cells, facets_of
from cellweave.plans import gather_halo, nearest, neighbour_pairs, owner, refresh_halo
from cellweave.sources import from_arrays, read_packing, to_array, write_packing, write_report, write_vtu
from cellweave.streaming import Follower, follow, latest_moves


def points(n, seed=0):
    return np.random.default_rng(seed).random((n, 3))


def test_arrays_round_trip_and_shapes_are_checked(spark):
    x = points(30)
    assert (to_array(from_arrays(spark, x, w=np.arange(30.0)), "x", "y", "z") == x).all()
    with pytest.raises(ValueError):
        from_arrays(spark, x[:, :2])
    with pytest.raises(ValueError):
        from_arrays(spark, x, w=np.arange(3.0))


def test_column_functions(spark):
    df = spark.createDataFrame([(-0.25, 5, 3, 1), (1.0, 7, 0, 7), (0.5, 0, 0, 0), (-0.5, 1, 1, 1), (0.75, 2, 2, 2)], "d double, i int, j int, k int")
    got = df.select(wrap(F.col("d"), 1.0).alias("w"), min_image(F.col("d"), 1.0).alias("m"), morton(F.col("i"), F.col("j"), F.col("k")).alias("z")).collect()
    assert [r["w"] for r in got] == [0.75, 0.0, 0.5, 0.5, 0.75] and [r["m"] for r in got] == [-0.25, 0.0, 0.5, -0.5, -0.25]
    z = lambda i, j, k: sum(((v >> b) & 1) << (3 * b + a) for a, v in enumerate((i, j, k)) for b in range(21))
    assert [r["z"] for r in got] == [z(5, 3, 1), z(7, 0, 7), 0, z(1, 1, 1), z(2, 2, 2)]


def test_joins_match_brute_force(spark):
    box = Box(1.0, 2.0, 1.5)
    x = points(120) * box.edges
    df = from_arrays(spark, x)
    d = x[None] - x[:, None]
    d -= box.edges * np.rint(d / box.edges)
    d2 = (d * d).sum(2)
    np.fill_diagonal(d2, np.inf)
    for radius in (0.2, 0.9):
        got = {(r["cell_id"], r["nbr_id"]) for r in neighbour_pairs(df, df, box, radius).collect()}
        assert got == set(zip(*(a.tolist() for a in np.nonzero(d2 <= radius**2))))
    near = nearest(df, df, box, 5, 120).collect()
    assert len(near) == 600
    want = np.argsort(d2, 1)[:, :5]
    assert all(want[r["cell_id"], r["rank"] - 1] == r["nbr_id"] for r in near)


def test_halo_owns_each_once_and_refreshes(spark):
    x, box, grid = points(200), Box(), (2, 3, 4)
    df = from_arrays(spark, x)
    halo = gather_halo(df, box, grid, 0.1).cache()
    assert halo.where("is_owned").count() == 200 == halo.where("is_owned").select("cell_id").distinct().count()
    assert halo.count() == halo.select("block", "cell_id").distinct().count()
    assert halo.where("is_owned").where(F.col("block") != owner(F.col("x"), F.col("y"), F.col("z"), box, grid)).count() == 0
    moved = df.withColumn("x", wrap(F.col("x") + 0.01, 1.0))
    assert refresh_halo(halo, moved).join(moved.withColumnRenamed("x", "nx"), "cell_id").where("x <> nx").count() == 0
    assert df.select(bin_id(F.col("x"), F.col("y"), F.col("z"), box, grid).alias("b")).distinct().count() == 24


def test_packing_and_vtu_and_report(spark, tmp_path):
    balls, seeds = np.hstack([points(4), np.full((4, 1), 0.05)]), points(40, 1)
    write_packing(str(tmp_path / "packing.txt"), balls, seeds, 0.0, 1.0)
    b, s, low, high = read_packing(spark, str(tmp_path / "packing.txt"))
    assert (low, high) == (0.0, 1.0) and (to_array(s, "x", "y", "z") == seeds).all() and b.count() == 4
    solids = shapes.walled_polyhedra(s, balls[:, :3].tolist(), balls[:, 3].tolist())
    n = write_vtu(str(tmp_path / "cells.vtu"), solids)
    text = (tmp_path / "cells.vtu").read_text()
    assert n == solids.count() and f'NumberOfCells="{n}"' in text and "faceoffsets" in text
    write_report(solids.select("cell_id", "volume"), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == n


def test_stream_of_moves_follows_and_completes_batches(spark, tmp_path):
    x = points(150)
    seeds = from_arrays(spark, x)
    f = Follower(Moving().build(seeds), seeds)
    y = x.copy()
    for step, rows in enumerate(([3, 4], [4, 70])):
        y[rows] = (y[rows] + 0.01) % 1
        spark.createDataFrame([(i, *map(float, y[i]), step) for i in rows] + [(999, 0.1, 0.1, 0.1, step), (5, None, 0.0, 0.0, step)], "cell_id long, x double, y double, z double, step int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell_id long, x double, y double, z double, step int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = follow(stream, f, str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    assert len(f.steps) == 2 and np.allclose(to_array(f.positions, "x", "y", "z"), y)
    diff = physics.compare_volumes(f.moving.cells, tessellate(from_arrays(spark, y))).first()
    assert diff["max_error"] < 1e-6
    moves = latest_moves(spark.createDataFrame([(1, "2024-01-01 00:01:00", 0.5), (11, "2024-01-01 00:02:00", 0.25)], "event_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts")), 10)
    assert [(r["cell_id"], r["moved"]) for r in moves.collect()] == [(1, 0.75)]


def test_a_new_driver_goes_on_behind_the_last_batch(spark, tmp_path):
    x = points(120)
    seeds = from_arrays(spark, x)

    def batch(i, *places):
        return spark.createDataFrame([(i, *p) for p in places], "cell_id long, x double, y double, z double")

    one, two = batch(7, (0.1, 0.2, 0.3), (0.1, 0.25, 0.1)), batch(9, (0.7, 0.7, 0.7))
    first = Follower(Moving().build(seeds), seeds, folder=str(tmp_path))
    first.apply(one, 0)
    x[7], x[9] = (0.1, 0.25, 0.1), (0.7, 0.7, 0.7)
    again = Follower(Moving(), seeds, folder=str(tmp_path))
    again.apply(one, 0)  # given again: skipped
    assert again.done == 0 and not again.steps
    again.apply(two, 1)
    assert len(again.steps) == 1 and np.allclose(to_array(again.positions, "x", "y", "z"), x)
    diff = physics.compare_volumes(again.moving.cells, tessellate(from_arrays(spark, x))).first()
    assert diff["max_error"] < 1e-6


def test_pore_cells_equal_those_of_the_whole_build(spark):
    x = points(1200, 6)
    seeds, balls, radii = from_arrays(spark, x), points(5, 2).tolist(), [0.1] * 5
    which = spark.createDataFrame([(i,) for i in (*range(0, 1200, 40), 3, 3, 5000)] + [(None,)], "cell_id long")
    got = shapes.pore_cells(seeds, which, balls, radii)
    whole = shapes.walled_cells(seeds, balls, radii)
    a = {r["cell_id"]: r for r in got.select("cell_id", "status", "volume", "n_facets").collect()}
    b = {r["cell_id"]: r for r in whole.select("cell_id", "status", "volume", "n_facets").collect()}
    assert got.count() == len(a) == 31 and 3 in a
    done = [i for i in a if a[i]["status"] != 1]
    assert len(done) > 25 and all(a[i]["volume"] == pytest.approx(b[i]["volume"], abs=1e-12) for i in done)
    assert all(a[i]["status"] == b[i]["status"] for i in done)
    few = shapes.pore_cells(seeds, which, balls, radii, k=6)
    assert few.where(F.col("status") == 1).count() > 20
    assert shapes.pore_cells(seeds, which.where("cell_id < 0"), balls, radii).count() == 0


@pytest.mark.parametrize("solid", [HalfSpace((0, 0, 0.3), (0, 0, 1)), Sphere((0.5, 0.5, 0.5), 0.25)])
def test_wall_force_by_finite_difference(spark, solid):
    x = points(90, 4)
    cells = tessellate(from_arrays(spark, x), sdf=solid)
    force = {r["cell_id"]: r for r in wall_force(facets_of(cells), cells, solid).collect()}
    rest = {r["cell_id"]: r for r in facets_of(cells).where("nbr_id >= 0").groupBy("cell_id").agg(*[F.sum(f"v{c}").alias(f"s{c}") for c in "xyz"]).collect()}
    walls = {r["cell_id"]: r["n"] for r in facets_of(cells).where("nbr_id = -2").groupBy("cell_id").agg(F.count("*").alias("n")).collect()}
    volume = lambda p, i: build_cells(p, np.arange(90), None, np.arange(90) == i, np.ones(3), 90, np.inf, sdf=solid)[0].geometry()["volume"][0]
    one = [i for i in force if walls[i] == 1][:3]
    for i in one:
        for k, c in enumerate("xyz"):
            a, b = x.copy(), x.copy()
            a[i, k] += 1e-5
            b[i, k] -= 1e-5
            fd = (volume(a, i) - volume(b, i)) / 2e-5
            assert force[i][f"f{c}"] - rest[i][f"s{c}"] == pytest.approx(fd, rel=2e-2, abs=2e-4)


def test_a_packing_read_in_many_parts_keeps_its_order(spark, tmp_path):
    rng = np.random.default_rng(4)
    balls, seeds = rng.random((900, 4)), rng.random((1100, 3))
    write_packing(str(tmp_path / "p.txt"), balls, seeds, 0.0, 1.0)
    keys = {"spark.sql.files.maxPartitionBytes": "6000", "spark.sql.files.openCostInBytes": "10"}
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path / "p.txt")).rdd.getNumPartitions() > 10
        b, s, _, _ = read_packing(spark, str(tmp_path / "p.txt"))
        assert (to_array(s, "x", "y", "z") == seeds).all()
        assert sorted(map(tuple, b.collect())) == sorted(map(tuple, balls.tolist()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_spheres_travel_as_one_row(spark):
    x, c = points(40), points(9, 1)
    balls = spark.createDataFrame([(*map(float, p), 0.1) for p in c], "cx double, cy double, cz double, r double")
    got = {r["cell_id"]: r["distance"] for r in spheres_distance(from_arrays(spark, x), balls, 1.0).collect()}
    d = x[:, None] - c
    want = np.sqrt(((d - np.round(d)) ** 2).sum(2)).min(1) - 0.1
    assert np.allclose([got[i] for i in range(40)], want, atol=1e-13)

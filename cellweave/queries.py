"""Queries over the test tables, with SQL that gives the same results where SQL can.

Seeds are fractional parts of embedding components (exact in both engines), in the unit box.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as G
from .box import Box
from .operators import moving, optimize, physics, shapes
from .operators.tessellate import facets_of, tessellate
from .operators.walls import PeriodicSpheres, spheres_distance
from .plans import candidate_lists, exclusive_scan, gather_halo, nearest, neighbour_pairs, reciprocal, refresh_halo, replicated
from .sources import from_arrays, seeds_from_embeddings, to_array

UNIT = Box()
#: Weights are this times a fraction; one literal for both engines.
WEIGHT = 0.25 * 500 ** (-2 / 3)
RADIUS, REACH, SHIFT, SKIN = 0.12, 0.05, 0.002, 0.0005


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return seeds_from_embeddings(spark, d)


def _frac(c):
    return c.cast("double") * 8 - F.floor(c.cast("double") * 8)


def _weighted(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("cell_id"), *[_frac(F.col("embedding")[i]).alias(c) for i, c in enumerate("xyz")], (_frac(F.col("embedding")[3]) * WEIGHT).alias("w"))


def _bodies(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("cell_id"), *[_frac(F.col("embedding")[i]).alias(c) for i, c in enumerate("xyz")], *[F.col("embedding")[4 + i].cast("double").alias(f"u{c}") for i, c in enumerate("xyz")], (1 + F.col("label") / 10.0).alias("mass"), (F.col("label") % 2).alias("phase"))


def _moved(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    at = lambda i: _frac(F.col("embedding")[i]) + F.lit(SHIFT) * F.col("embedding")[10 + i].cast("double")
    return e.select(F.col("vec_id").alias("cell_id"), *[(at(i) - F.floor(at(i))).alias(c) for i, c in enumerate("xyz")])


def seed_binning(spark, d):
    s = _seeds(spark, d)
    return s.groupBy(G.bin_id(F.col("x"), F.col("y"), F.col("z"), UNIT, (5, 5, 5)).alias("bin")).agg(F.count("*").alias("n"))


def morton_code(spark, d):
    s = _seeds(spark, d)
    return s.select("cell_id", G.morton(*[G.bin_index(F.col(c), 1.0, 8) for c in "xyz"]).alias("code"))


def neighbor_range_join(spark, d):
    s = _seeds(spark, d)
    return neighbour_pairs(s, s, UNIT, RADIUS).select("cell_id", "nbr_id", F.round("d2", 12).alias("d2"))


def knn_closest_first(spark, d):
    s = _seeds(spark, d)
    return nearest(s, s, UNIT, 8, s.count()).select("cell_id", F.col("rank").cast("int").alias("rank"), "nbr_id", F.round("d2", 12).alias("d2"))


def nearest_seed_assignment(spark, d):
    both = seeds_from_embeddings(spark, d, 2)
    seeds = both.where("cell_id % 2 = 0").withColumn("cell_id", F.expr("cell_id div 2"))
    points = both.where("cell_id % 2 = 1").withColumn("cell_id", F.expr("-1 - (cell_id div 2)"))
    return nearest(points, seeds, UNIT, 1, seeds.count()).select((-1 - F.col("cell_id")).alias("point_id"), F.col("nbr_id").alias("seed_id"))


def block_halo_replication(spark, d):
    return replicated(_seeds(spark, d), UNIT, (3, 3, 3), REACH).select("block", "cell_id", "is_owned")


def voronoi_cells(spark, d):
    return tessellate(_seeds(spark, d), topology=False).select("cell_id", F.round("volume", 10).alias("volume"), "n_facets")


def voronoi_facets(spark, d):
    f = facets_of(tessellate(_seeds(spark, d), topology=False))
    return f.where("area > 1e-7").select("cell_id", "nbr_id", F.round("area", 9).alias("area"))


def transport_laplacian(spark, d):
    edges = optimize.laplacian(facets_of(tessellate(_seeds(spark, d), topology=False)).where("area > 1e-7"))
    return edges.select("i", "j", F.round("weight", 7).alias("weight"))


def tessellation_invariants(spark, d):
    i = physics.invariants(tessellate(_seeds(spark, d), topology=False), UNIT)
    return i.select(*[(F.round(c, k) + 0.0).alias(c) for c, k in (("volume_error", 9), ("area_sum", 7), ("dv_sum", 7), ("area_asymmetry", 3))], "one_sided")


def pressure_force(spark, d):
    s = _seeds(spark, d)
    n = s.count()
    f = physics.pressure_force(tessellate(s, topology=False), 1.0, 1.0 / n)
    return f.select("cell_id", *[(F.round(f"f{c}", 7) + 0.0).alias(f"f{c}") for c in "xyz"])


def internal_energy(spark, d):
    s = _seeds(spark, d)
    return physics.internal_energy(tessellate(s, topology=False), 1.0, 1.0 / s.count()).select(F.round("internal_energy", 8).alias("internal_energy"))


def interface_energy(spark, d):
    b = _bodies(spark, d)
    tension = spark.createDataFrame([(1, 0, 2.5)], "phase_i int, phase_j int, tension double")
    e = physics.interface_energy(tessellate(b, topology=False), b.select("cell_id", "phase"), tension)
    return e.select(F.round("interface_energy", 7).alias("interface_energy"))


def velocity_gradient(spark, d):
    b = _bodies(spark, d)
    g = physics.velocity_gradient(tessellate(b, topology=False).join(b.select("cell_id", "ux", "uy", "uz"), "cell_id"))
    return g.select("cell_id", *[(F.round(c, 5) + 0.0).alias(c) for c in g.columns if c != "cell_id"])


def viscous_force(spark, d):
    b = _bodies(spark, d)
    cells = tessellate(b, topology=False)
    g = physics.velocity_gradient(cells.join(b.select("cell_id", "ux", "uy", "uz"), "cell_id"))
    f = physics.viscous_force(cells, physics.stress(g, F.lit(0.1), F.lit(0.02)))
    return f.select("cell_id", *[(F.round(f"f{c}", 6) + 0.0).alias(f"f{c}") for c in "xyz"])


def kinetic_energy(spark, d):
    return physics.kinetic_energy(_bodies(spark, d)).select(F.round("kinetic_energy", 9).alias("kinetic_energy"))


def power_cells(spark, d):
    return tessellate(_weighted(spark, d), weighted=True, topology=False).select("cell_id", F.round("volume", 9).alias("volume"), "n_facets", "status")


def power_buried(spark, d):
    c = tessellate(_weighted(spark, d), weighted=True, topology=False)
    return c.where("status = 2").select("cell_id")


def verlet_movers(spark, d):
    return moving.flag_movers(_moved(spark, d), _seeds(spark, d), UNIT, SKIN)


def max_displacement(spark, d):
    return moving.max_displacement(_moved(spark, d), _seeds(spark, d), UNIT).select(F.round("max_displacement", 12).alias("max_displacement"))


def spheres_sdf(spark, d):
    s = _seeds(spark, d)
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("label = 0").select("vec_id")
    balls = s.join(e, s["cell_id"] == e["vec_id"]).select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), F.lit(0.05).alias("r"))
    return spheres_distance(s, balls, UNIT).select("cell_id", F.round("distance", 11).alias("distance"))


def _spheres(spark, d) -> PeriodicSpheres:
    c = to_array(_seeds(spark, d).where("cell_id % 50 = 0"), "x", "y", "z")
    return PeriodicSpheres(tuple(map(tuple, c.tolist())), (0.06,) * len(c), UNIT)


def walled_cells(spark, d):
    return tessellate(_seeds(spark, d), sdf=_spheres(spark, d), topology=False).select("cell_id", F.round("volume", 9).alias("volume"), "n_facets", "status")


def cell_sections(spark, d):
    cells = tessellate(_seeds(spark, d))
    return shapes.sections(cells, (0.5, 0.5, 0.5), (0.0, 0.0, 1.0)).select("cell_id", F.round("area", 8).alias("area"), F.size("polygon").alias("sides"))


def cell_polyhedra(spark, d):
    p = shapes.polyhedra(tessellate(_seeds(spark, d)))
    return p.select("cell_id", F.size("points").alias("points"), F.size("faces").alias("faces"), F.round("volume", 9).alias("volume"))


def moving_step(spark, d):
    m = moving.Moving(UNIT, tolerance=1e-9).build(_seeds(spark, d))
    m.step(_moved(spark, d))
    return m.cells.select("cell_id", F.round("volume", 6).alias("volume"), "n_facets")


def fluid_steps(spark, d):
    s = physics.Simulation(_bodies(spark, d), UNIT).init().step(2, 1e-4)
    return s.bodies.select("cell_id", *[F.round(c, 9).alias(c) for c in ("x", "y", "z", "ux", "uy", "uz")])


def wrapped_positions(spark, d):
    s = _seeds(spark, d)
    return s.select("cell_id", *[G.wrap(F.col(c) * 3.0 - 1.0, 1.0).alias(c) for c in "xyz"])


def plane_offsets(spark, d):
    w = _weighted(spark, d).select("cell_id", "w")
    s = _seeds(spark, d)
    p = neighbour_pairs(s, s, UNIT, RADIUS).join(w, "cell_id").join(w.select(F.col("cell_id").alias("nbr_id"), F.col("w").alias("wn")), "nbr_id")
    r = tuple(F.col(c) for c in ("rx", "ry", "rz"))
    return p.select("cell_id", "nbr_id", F.round(G.plane_offset(r), 12).alias("voronoi"), F.round(G.plane_offset(r, F.col("w"), F.col("wn")), 12).alias("power"))


def reach_bounds(spark, d):
    s = _weighted(spark, d)
    w_max = s.agg(F.max("w")).first()[0]
    c = tessellate(s, weighted=True, topology=False)
    return c.select("cell_id", F.round("r2_max", 9).alias("r2_max"), F.round(G.reach2(F.col("r2_max"), F.col("w"), w_max), 8).alias("reach2"))


def neighbor_counts(spark, d):
    return tessellate(_seeds(spark, d), topology=False).select("cell_id", "n_neighbors")


def max_facets(spark, d):
    return tessellate(_seeds(spark, d), topology=False).agg(F.max("n_facets").alias("max_facets"))


def facet_offsets(spark, d):
    cells = tessellate(_seeds(spark, d), topology=False).select("cell_id", "n_facets")
    return exclusive_scan(cells, "cell_id", "n_facets", "first_facet", 100)


def reciprocal_facets(spark, d):
    f = facets_of(tessellate(_seeds(spark, d), topology=False)).where("area > 1e-7")
    return reciprocal(f).select("cell_id", "nbr_id", F.round("area", 9).alias("area"), F.round("back_area", 9).alias("back_area"))


def volume_gradient(spark, d):
    g = physics.seed_gradient(tessellate(_seeds(spark, d), topology=False), F.col("volume"))
    return g.select("cell_id", *[(F.round(f"g{c}", 9) + 0.0).alias(f"g{c}") for c in "xyz"])


def stress_tensor(spark, d):
    b = _bodies(spark, d)
    g = physics.velocity_gradient(tessellate(b, topology=False).join(b.select("cell_id", "ux", "uy", "uz"), "cell_id"))
    t = physics.stress(g, F.lit(0.1), F.lit(0.02))
    return t.select("cell_id", *[(F.round(c, 5) + 0.0).alias(c) for c in t.columns if c != "cell_id"])


def volume_difference(spark, d):
    now, then = (tessellate(s, topology=False) for s in (_moved(spark, d), _seeds(spark, d)))
    r = physics.compare_volumes(now, then)
    return r.select(F.round("mean_error", 9).alias("mean_error"), F.round("max_error", 8).alias("max_error"), "large")


def neighbour_changes(spark, d):
    return physics.compare_neighbours(*(tessellate(s, topology=False) for s in (_moved(spark, d), _seeds(spark, d))))


def skin_histogram(spark, d):
    m = _moved(spark, d)
    return moving.flagged_nearby(m.join(moving.flag_movers(m, _seeds(spark, d), UNIT, SKIN), "cell_id", "left_semi"), UNIT, (5, 5, 5))


def dilated_movers(spark, d):
    m = _moved(spark, d)
    return moving.dilated(m, m.join(moving.flag_movers(m, _seeds(spark, d), UNIT, SKIN), "cell_id", "left_semi"), UNIT, (5, 5, 5), 70)


def mover_partners(spark, d):
    s, m = _seeds(spark, d), _moved(spark, d)
    f = facets_of(tessellate(s, topology=False)).where("area > 1e-7")
    return moving.partners(f, moving.flag_movers(m, s, UNIT, 1.4 * SKIN))


def candidate_sets(spark, d):
    s = _seeds(spark, d)
    return candidate_lists(s, s, UNIT, RADIUS).select("cell_id", F.array_join("candidates", " ").alias("candidates"))


def halo_refresh(spark, d):
    h = refresh_halo(gather_halo(_seeds(spark, d), UNIT, (3, 3, 3), REACH), _moved(spark, d))
    return h.select("block", "cell_id", "is_owned", F.round("x", 12).alias("x"))


def sphere_distances(spark, d):
    s = _seeds(spark, d)
    return s.select("cell_id", F.round(G.sphere_distance(*[F.col(c) for c in "xyz"], (0.5, 0.5, 0.5), 0.25), 12).alias("distance"))


def _outcome(spark, r, *names):
    """The positions of an optimiser's result, with how it ended beside each."""
    return from_arrays(spark, r.positions).select("*", *[F.lit(getattr(r, c)).alias(c) for c in names])


def volume_mesh(spark, d):
    x = to_array(_seeds(spark, d), "x", "y", "z")
    r = optimize.optimize_volume_mesh(x, np.full(len(x), 1 / len(x)), spark=spark)
    return _outcome(spark, r, "converged", "iters", "max_vol_err", "mean_vol_err")


def interface_mesh(spark, d):
    b = _bodies(spark, d)
    x, t = to_array(b, "x", "y", "z"), to_array(b, "phase")
    return _outcome(spark, optimize.minimize_interface(x, t, spark=spark), "converged", "iters", "energy", "energy_ratio")


_SEEDS = "seeds AS (SELECT vec_id AS cell_id, label, embedding, " + ", ".join(f"embedding[{i + 1}]::DOUBLE * 8 - floor(embedding[{i + 1}]::DOUBLE * 8) AS {c}" for i, c in enumerate("xyz")) + " FROM embeddings)"
_MIN = "CASE WHEN {d} > 0.5 THEN {d} - 1 WHEN {d} < -0.5 THEN {d} + 1 ELSE {d} END"
_REL = ", ".join(_MIN.format(d=f"(b.{c} - a.{c})") + f" AS r{c}" for c in "xyz")
_PAIRS = f"pairs AS MATERIALIZED (SELECT *, rx * rx + ry * ry + rz * rz AS d2 FROM (SELECT a.cell_id, b.cell_id AS nbr_id, {_REL} FROM seeds a JOIN seeds b ON a.cell_id <> b.cell_id))"


def _bin(c: str, n: int) -> str:
    return f"((floor({c} * {n})::BIGINT % {n} + {n}) % {n})"


# An exact Voronoi diagram by enumeration: corners of the cells of the 32 nearest and the box, then of
# those planes that are on such a corner or cut one off; planes that cut no corner of a larger cell
# can't cut the cell.
_CORNERS = """
  SELECT cell_id, a, b, c, det, ({ha} * bcx + {hb} * cax + {hc} * abx) / det AS vx, ({ha} * bcy + {hb} * cay + {hc} * aby) / det AS vy, ({ha} * bcz + {hb} * caz + {hc} * abz) / det AS vz
  FROM (SELECT p.cell_id, p.nbr_id AS a, q.nbr_id AS b, s.nbr_id AS c, p.h AS h1, q.h AS h2, s.h AS h3,
          q.uy*s.uz - q.uz*s.uy AS bcx, q.uz*s.ux - q.ux*s.uz AS bcy, q.ux*s.uy - q.uy*s.ux AS bcz,
          s.uy*p.uz - s.uz*p.uy AS cax, s.uz*p.ux - s.ux*p.uz AS cay, s.ux*p.uy - s.uy*p.ux AS caz,
          p.uy*q.uz - p.uz*q.uy AS abx, p.uz*q.ux - p.ux*q.uz AS aby, p.ux*q.uy - p.uy*q.ux AS abz,
          p.ux*(q.uy*s.uz - q.uz*s.uy) + p.uy*(q.uz*s.ux - q.ux*s.uz) + p.uz*(q.ux*s.uy - q.uy*s.ux) AS det
        FROM {t} p JOIN {t} q ON p.cell_id = q.cell_id AND p.nbr_id < q.nbr_id JOIN {t} s ON q.cell_id = s.cell_id AND q.nbr_id < s.nbr_id)
  WHERE abs(det) > 1e-12""".replace("{ha}", "h1").replace("{hb}", "h2").replace("{hc}", "h3")
_INSIDE = "SELECT v.* FROM {v} v ANTI JOIN {t} p ON v.cell_id = p.cell_id AND p.nbr_id <> v.a AND p.nbr_id <> v.b AND p.nbr_id <> v.c AND p.ux * v.vx + p.uy * v.vy + p.uz * v.vz > p.h"
_FLAGS = " UNION ALL ".join(
    f"SELECT cell_id, {f} AS f, {g} AS g, {s} * sign(det) AS s, vx, vy, vz FROM corners" for f, g, s in (("a", "b", 1), ("a", "c", -1), ("b", "c", 1), ("b", "a", -1), ("c", "a", 1), ("c", "b", -1))
)
_VORONOI = f"""
  {_SEEDS}, {_PAIRS},
  planes AS MATERIALIZED (
    SELECT cell_id, nbr_id, rx / sqrt(d2) AS ux, ry / sqrt(d2) AS uy, rz / sqrt(d2) AS uz, sqrt(d2) / 2 AS h, d2, row_number() OVER (PARTITION BY cell_id ORDER BY d2, nbr_id) AS k FROM pairs
    UNION ALL SELECT cell_id, -1 - i, CASE i WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END, CASE i WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END, CASE i WHEN 4 THEN -1 WHEN 5 THEN 1 ELSE 0 END, 0.5, 1, 0 FROM seeds, range(6) t(i)
  ),
  near AS MATERIALIZED (SELECT * FROM planes WHERE k <= 32),
  tried AS MATERIALIZED ({_CORNERS.replace("{t}", "near")}),
  first AS MATERIALIZED ({_INSIDE.replace("{v}", "tried").replace("{t}", "near")}),
  used AS (SELECT DISTINCT cell_id, unnest([a, b, c]) AS nbr_id FROM first),
  kept AS MATERIALIZED (
    SELECT p.* FROM planes p SEMI JOIN used u ON p.cell_id = u.cell_id AND p.nbr_id = u.nbr_id
    UNION SELECT p.* FROM planes p SEMI JOIN first v ON p.cell_id = v.cell_id AND p.k > 32 AND p.ux * v.vx + p.uy * v.vy + p.uz * v.vz > p.h
  ),
  again AS MATERIALIZED ({_CORNERS.replace("{t}", "kept")}),
  corners AS MATERIALIZED ({_INSIDE.replace("{v}", "again").replace("{t}", "kept")}),
  flags AS ({_FLAGS}),
  edges AS (
    SELECT *, fx + (qx - px * dt) * al AS ex, fy + (qy - py * dt) * al AS ey, fz + (qz - pz * dt) * al AS ez FROM (
      SELECT w.cell_id, w.f, w.s, w.vx, w.vy, w.vz, p.h, p.ux AS px, p.uy AS py, p.uz AS pz, q.ux AS qx, q.uy AS qy, q.uz AS qz, p.ux * p.h AS fx, p.uy * p.h AS fy, p.uz * p.h AS fz,
        p.ux*q.ux + p.uy*q.uy + p.uz*q.uz AS dt, (q.h - p.h * (p.ux*q.ux + p.uy*q.uy + p.uz*q.uz)) / (1 - (p.ux*q.ux + p.uy*q.uy + p.uz*q.uz) ** 2) AS al
      FROM flags w JOIN kept p ON w.cell_id = p.cell_id AND w.f = p.nbr_id JOIN kept q ON w.cell_id = q.cell_id AND w.g = q.nbr_id)
  ),
  parts AS (
    SELECT cell_id, f, h, px, py, pz, (fx + ex + vx) / 3 AS mx, (fy + ey + vy) / 3 AS my, (fz + ez + vz) / 3 AS mz,
      s * 0.5 * (px * ((ey-fy)*(vz-fz) - (ez-fz)*(vy-fy)) + py * ((ez-fz)*(vx-fx) - (ex-fx)*(vz-fz)) + pz * ((ex-fx)*(vy-fy) - (ey-fy)*(vx-fx))) AS ar
    FROM edges
  ),
  facets AS MATERIALIZED (
    SELECT cell_id, f AS nbr_id, any_value(h) AS h, any_value(px) AS px, any_value(py) AS py, any_value(pz) AS pz, sum(ar) AS area,
      sum(ar * mx) AS sx, sum(ar * my) AS sy, sum(ar * mz) AS sz FROM parts GROUP BY cell_id, f
  ),
  dv AS (SELECT *, area / (2 * h) * (2 * h * px - sx / area) AS vx, area / (2 * h) * (2 * h * py - sy / area) AS vy, area / (2 * h) * (2 * h * pz - sz / area) AS vz FROM facets),
  cells AS MATERIALIZED (SELECT cell_id, sum(area * h) / 3 AS volume, count(*) AS n_facets FROM facets GROUP BY cell_id)
"""

_MOVED = "moved AS (SELECT vec_id AS cell_id, " + ", ".join(f"m{c} - floor(m{c}) AS {c}" for c in "xyz") + " FROM (SELECT vec_id, " + ", ".join(f"(embedding[{i + 1}]::DOUBLE * 8 - floor(embedding[{i + 1}]::DOUBLE * 8)) + {SHIFT!r}::DOUBLE * embedding[{11 + i}]::DOUBLE AS m{c}" for i, c in enumerate("xyz")) + " FROM embeddings))"
_DISP = f"disp AS (SELECT cell_id, rx * rx + ry * ry + rz * rz AS moved2 FROM (SELECT a.cell_id, {_REL} FROM seeds a JOIN moved b USING (cell_id)))"


def _spread(c: str) -> str:
    return "(" + " | ".join(f"((({c} >> {k}) & 1) << {3 * k})" for k in range(3)) + ")"


def _halo() -> str:
    axes = ", ".join(f"list_distinct([((k % 3) + 3) % 3 FOR k IN range(floor(({c} - {REACH}) / (1.0 / 3))::BIGINT, floor(({c} + {REACH}) / (1.0 / 3))::BIGINT + 1)]) AS l{c}" for c in "xyz")
    own = f"{_bin('x', 3)} + 3 * ({_bin('y', 3)} + 3 * {_bin('z', 3)})"
    return f"""WITH {_SEEDS}, s AS (SELECT cell_id, {own} AS own, {axes} FROM seeds),
      i AS (SELECT cell_id, own, unnest(lx) AS i, ly, lz FROM s), j AS (SELECT cell_id, own, i, unnest(ly) AS j, lz FROM i), k AS (SELECT cell_id, own, i, j, unnest(lz) AS k FROM j)
      SELECT (i + 3 * (j + 3 * k))::BIGINT AS block, cell_id, i + 3 * (j + 3 * k) = own AS is_owned FROM k"""


_WEIGHT = f"(embedding[4]::DOUBLE * 8 - floor(embedding[4]::DOUBLE * 8)) * {WEIGHT!r}::DOUBLE AS w"
#: The diagram of moved seeds, and of weighted ones, in which a covered seed has no planes.
_VORONOI_MOVED = _VORONOI.replace(_SEEDS, _MOVED.replace("moved AS", "seeds AS", 1))
_POWER = (
    _VORONOI.replace("embedding, embedding[1]", f"embedding, {_WEIGHT}, embedding[1]")
    .replace("SELECT a.cell_id, b.cell_id AS nbr_id,", "SELECT a.cell_id, b.cell_id AS nbr_id, a.w AS wa, b.w AS wb,")
    .replace("planes AS MATERIALIZED", "buried AS MATERIALIZED (SELECT DISTINCT cell_id FROM pairs WHERE d2 + wa <= wb),\n  planes AS MATERIALIZED")
    .replace("sqrt(d2) / 2 AS h", "(d2 + wa - wb) / (2 * sqrt(d2)) AS h")
    .replace("ORDER BY d2, nbr_id) AS k FROM pairs", "ORDER BY (d2 + wa - wb) / sqrt(d2), nbr_id) AS k FROM pairs ANTI JOIN buried USING (cell_id)")
    .replace("FROM seeds, range(6) t(i)", "FROM seeds ANTI JOIN buried USING (cell_id), range(6) t(i)")
)
_GRADIENT = f"""u AS (SELECT vec_id AS cell_id, embedding[5]::DOUBLE AS ux, embedding[6]::DOUBLE AS uy, embedding[7]::DOUBLE AS uz FROM embeddings),
      g AS (SELECT f.cell_id, {", ".join(f"sum(ui.u{p} * f.v{k} - uj.u{p} * g.v{k}) / any_value(c.volume) AS g_{p}{k}" for p in "xyz" for k in "xyz")}
      FROM dv f JOIN dv g ON f.cell_id = g.nbr_id AND f.nbr_id = g.cell_id JOIN u ui ON f.cell_id = ui.cell_id JOIN u uj ON f.nbr_id = uj.cell_id JOIN cells c ON f.cell_id = c.cell_id GROUP BY f.cell_id)"""
_STRESS = "t AS (SELECT cell_id, " + ", ".join(f"0.1::DOUBLE * (g_{k}{m} + g_{m}{k})" + (" + (0.02::DOUBLE - 2.0::DOUBLE / 3.0::DOUBLE * 0.1::DOUBLE) * (g_xx + g_yy + g_zz)" if k == m else "") + f" AS t_{k}{m}" for k in "xyz" for m in "xyz") + " FROM g)"
_AROUND = "b AS (SELECT " + ", ".join(f"{_bin(c, 5)} AS {a}" for a, c in zip("ijk", "xyz")) + " FROM moved SEMI JOIN (SELECT cell_id FROM disp WHERE moved2 > ({skin}::DOUBLE / 2) ** 2) USING (cell_id)), near AS (SELECT ((i + di + 5) % 5 + 5 * ((j + dj + 5) % 5 + 5 * ((k + dk + 5) % 5)))::BIGINT AS bin, count(*)::BIGINT AS n FROM b, range(-1, 2) p(di), range(-1, 2) q(dj), range(-1, 2) r(dk) GROUP BY 1)".replace("{skin}", repr(SKIN))
#: Where a cell's edges, between corners that share two planes, cross the plane z = 1/2.
_CUT = """sides AS (SELECT v.cell_id, v.a, v.b, v.c, v.vx + s.x AS x, v.vy + s.y AS y, v.vz + s.z - 0.5 AS h FROM corners v JOIN seeds s USING (cell_id)),
      cut AS (SELECT p.cell_id, p.x + p.h / (p.h - q.h) * (q.x - p.x) AS x, p.y + p.h / (p.h - q.h) * (q.y - p.y) AS y FROM sides p JOIN sides q ON p.cell_id = q.cell_id AND p.h > 0 AND q.h <= 0
        AND len(list_intersect([p.a, p.b, p.c], [q.a, q.b, q.c])) = 2),
      ring AS (SELECT *, atan2(y - avg(y) OVER (PARTITION BY cell_id), x - avg(x) OVER (PARTITION BY cell_id)) AS t FROM cut),
      turn AS (SELECT cell_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS ex, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ey FROM ring WINDOW w AS (PARTITION BY cell_id ORDER BY t))"""


SQL = {
    "seed_binning": f"WITH {_SEEDS} SELECT ({_bin('x', 5)} + 5 * ({_bin('y', 5)} + 5 * {_bin('z', 5)}))::BIGINT AS bin, count(*) AS n FROM seeds GROUP BY 1",
    "morton_code": f"WITH {_SEEDS}, b AS (SELECT cell_id, {_bin('x', 8)} AS i, {_bin('y', 8)} AS j, {_bin('z', 8)} AS k FROM seeds) SELECT cell_id, ({_spread('i')} | ({_spread('j')} << 1) | ({_spread('k')} << 2))::BIGINT AS code FROM b",
    "neighbor_range_join": f"WITH {_SEEDS}, {_PAIRS} SELECT cell_id, nbr_id, round(d2, 12) AS d2 FROM pairs WHERE d2 <= {RADIUS!r}::DOUBLE * {RADIUS!r}::DOUBLE",
    "knn_closest_first": f"WITH {_SEEDS}, {_PAIRS} SELECT cell_id, rank::INTEGER AS rank, nbr_id, round(d2, 12) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d2, nbr_id) AS rank FROM pairs) WHERE rank <= 8",
    "nearest_seed_assignment": "WITH seeds AS (SELECT vec_id, " + ", ".join(f"embedding[{i}]::DOUBLE * 8 - floor(embedding[{i}]::DOUBLE * 8) AS c{i}" for i in range(1, 7)) + " FROM embeddings), " + "r AS (SELECT p.vec_id AS point_id, s.vec_id AS seed_id, " + ", ".join(_MIN.format(d=f"(s.c{i} - p.c{i + 3})") + f" AS r{i}" for i in (1, 2, 3)) + " FROM seeds p, seeds s) SELECT point_id, seed_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY r1*r1 + r2*r2 + r3*r3, seed_id) AS k FROM r) WHERE k = 1",
    "block_halo_replication": _halo(),
    "voronoi_cells": f"WITH {_VORONOI} SELECT cell_id, round(volume, 10) AS volume, n_facets::INTEGER AS n_facets FROM cells",
    "voronoi_facets": f"WITH {_VORONOI} SELECT cell_id, CASE WHEN nbr_id < 0 THEN -1 ELSE nbr_id END AS nbr_id, round(area, 9) AS area FROM facets WHERE area > 1e-7",
    "transport_laplacian": f"WITH {_VORONOI} SELECT cell_id AS i, nbr_id AS j, round(area / (4 * h), 7) AS weight FROM facets WHERE nbr_id >= 0 AND area > 1e-7",
    "tessellation_invariants": f"WITH {_VORONOI} SELECT round(abs((SELECT sum(volume) FROM cells) - 1), 9) AS volume_error, round(sqrt(sum(area * px) ** 2 + sum(area * py) ** 2 + sum(area * pz) ** 2), 7) + 0.0 AS area_sum, (SELECT round(sqrt(sum(vx) ** 2 + sum(vy) ** 2 + sum(vz) ** 2), 7) + 0.0 FROM dv) AS dv_sum, (SELECT round(max(sqrt((f.area * f.px + g.area * g.px) ** 2 + (f.area * f.py + g.area * g.py) ** 2 + (f.area * f.pz + g.area * g.pz) ** 2) / f.area), 3) + 0.0 FROM facets f JOIN facets g ON f.cell_id = g.nbr_id AND f.nbr_id = g.cell_id) AS area_asymmetry, (SELECT count(*) FROM facets f ANTI JOIN facets g ON f.cell_id = g.nbr_id AND f.nbr_id = g.cell_id WHERE f.nbr_id >= 0) AS one_sided FROM facets",
    "pressure_force": f"""WITH {_VORONOI}, p AS (SELECT cell_id, 1.0::DOUBLE / (SELECT count(*) FROM seeds) / volume AS p FROM cells)
      SELECT f.cell_id, {", ".join(f"round(sum(coalesce(pj.p * g.v{c}, 0) - pi.p * f.v{c}), 7) + 0.0 AS f{c}" for c in "xyz")}
      FROM dv f JOIN p pi ON f.cell_id = pi.cell_id LEFT JOIN dv g ON f.cell_id = g.nbr_id AND f.nbr_id = g.cell_id LEFT JOIN p pj ON g.cell_id = pj.cell_id GROUP BY f.cell_id""",
    "internal_energy": f"WITH {_VORONOI} SELECT round(-sum(ln(volume * (SELECT count(*) FROM seeds))) / (SELECT count(*) FROM seeds), 8) AS internal_energy FROM cells",
    "interface_energy": f"WITH {_VORONOI} SELECT round(sum(2.5::DOUBLE * area), 7) AS interface_energy FROM facets JOIN seeds a USING (cell_id) JOIN seeds b ON facets.nbr_id = b.cell_id WHERE a.label % 2 = 1 AND b.label % 2 = 0",
    "velocity_gradient": f"""WITH {_VORONOI}, u AS (SELECT vec_id AS cell_id, embedding[5]::DOUBLE AS ux, embedding[6]::DOUBLE AS uy, embedding[7]::DOUBLE AS uz FROM embeddings)
      SELECT f.cell_id, {", ".join(f"round(sum(ui.u{p} * f.v{k} - uj.u{p} * g.v{k}) / any_value(c.volume), 5) + 0.0 AS g_{p}{k}" for p in "xyz" for k in "xyz")}
      FROM dv f JOIN dv g ON f.cell_id = g.nbr_id AND f.nbr_id = g.cell_id JOIN u ui ON f.cell_id = ui.cell_id JOIN u uj ON f.nbr_id = uj.cell_id JOIN cells c ON f.cell_id = c.cell_id GROUP BY f.cell_id""",
    "kinetic_energy": "SELECT round(0.5::DOUBLE * sum((1 + label / 10.0::DOUBLE) * (" + " + ".join(f"embedding[{i}]::DOUBLE * embedding[{i}]::DOUBLE" for i in (5, 6, 7)) + ")), 9) AS kinetic_energy FROM embeddings",
    "power_buried": f"WITH {_SEEDS}, {_PAIRS}, w AS (SELECT cell_id, (embedding[4]::DOUBLE * 8 - floor(embedding[4]::DOUBLE * 8)) * {WEIGHT!r}::DOUBLE AS w FROM seeds) SELECT DISTINCT p.cell_id FROM pairs p JOIN w a ON p.cell_id = a.cell_id JOIN w b ON p.nbr_id = b.cell_id WHERE p.d2 + a.w <= b.w",
    "verlet_movers": f"WITH {_SEEDS}, {_MOVED}, {_DISP} SELECT cell_id FROM disp WHERE moved2 > ({SKIN!r}::DOUBLE / 2) ** 2",
    "max_displacement": f"WITH {_SEEDS}, {_MOVED}, {_DISP} SELECT round(sqrt(max(moved2)), 12) AS max_displacement FROM disp",
    "spheres_sdf": f"WITH {_SEEDS}, r AS (SELECT a.cell_id, " + ", ".join(f"(a.{c} - b.{c}) - round(a.{c} - b.{c}) AS d{c}" for c in "xyz") + " FROM seeds a, seeds b WHERE b.label = 0) SELECT cell_id, round(min(sqrt(dx*dx + dy*dy + dz*dz) - 0.05::DOUBLE), 11) AS distance FROM r GROUP BY cell_id",
    "wrapped_positions": f"WITH {_SEEDS} SELECT cell_id, " + ", ".join(f"({c} * 3.0::DOUBLE - 1) - floor({c} * 3.0::DOUBLE - 1) AS {c}" for c in "xyz") + " FROM seeds",
    "plane_offsets": f"WITH {_SEEDS}, {_PAIRS}, w AS (SELECT cell_id, {_WEIGHT} FROM seeds) SELECT p.cell_id, nbr_id, round(d2 / 2, 12) AS voronoi, round((d2 + a.w - b.w) / 2, 12) AS power FROM pairs p JOIN w a ON p.cell_id = a.cell_id JOIN w b ON p.nbr_id = b.cell_id WHERE d2 <= {RADIUS!r}::DOUBLE * {RADIUS!r}::DOUBLE",
    "reach_bounds": f"WITH {_POWER}, r AS (SELECT s.cell_id, any_value(s.w) AS w, coalesce(max(vx * vx + vy * vy + vz * vz), 0) AS r2 FROM seeds s LEFT JOIN corners c USING (cell_id) GROUP BY s.cell_id) SELECT cell_id, round(r2, 9) AS r2_max, round((sqrt(r2) + sqrt(r2 + greatest((SELECT max(w) FROM seeds) - w, 0))) ** 2, 8) AS reach2 FROM r",
    "neighbor_counts": f"WITH {_VORONOI} SELECT cell_id, count(DISTINCT f)::INTEGER AS n_neighbors FROM flags GROUP BY cell_id",
    "max_facets": f"WITH {_VORONOI} SELECT max(n_facets)::INTEGER AS max_facets FROM cells",
    "facet_offsets": f"WITH {_VORONOI} SELECT cell_id, n_facets::INTEGER AS n_facets, (sum(n_facets) OVER (ORDER BY cell_id) - n_facets)::BIGINT AS first_facet FROM cells",
    "reciprocal_facets": f"WITH {_VORONOI} SELECT f.cell_id, f.nbr_id, round(f.area, 9) AS area, round(g.area, 9) AS back_area FROM facets f LEFT JOIN facets g ON f.cell_id = g.nbr_id AND f.nbr_id = g.cell_id AND g.area > 1e-7 WHERE f.nbr_id >= 0 AND f.area > 1e-7",
    "volume_gradient": f"WITH {_VORONOI}, d AS (SELECT cell_id, nbr_id, volume * vx AS x, volume * vy AS y, volume * vz AS z FROM dv JOIN cells USING (cell_id) WHERE nbr_id >= 0) SELECT cell_id, " + ", ".join(f"round(sum({c}), 9) + 0.0 AS g{c}" for c in "xyz") + " FROM (SELECT nbr_id AS cell_id, x, y, z FROM d UNION ALL SELECT cell_id, -x, -y, -z FROM d) GROUP BY cell_id",
    "stress_tensor": f"WITH {_VORONOI}, {_GRADIENT}, {_STRESS} SELECT cell_id, " + ", ".join(f"round(t_{k}{m}, 5) + 0.0 AS t_{k}{m}" for k in "xyz" for m in "xyz") + " FROM t",
    "viscous_force": f"WITH {_VORONOI}, {_GRADIENT}, {_STRESS} SELECT f.cell_id, " + ", ".join("round(sum(" + " + ".join(f"(j.t_{k}{m} - i.t_{k}{m}) * f.v{m}" for m in "xyz") + f"), 6) + 0.0 AS f{k}" for k in "xyz") + " FROM dv f JOIN t i ON f.cell_id = i.cell_id JOIN t j ON f.nbr_id = j.cell_id GROUP BY f.cell_id",
    "power_cells": f"WITH {_POWER} SELECT s.cell_id, round(coalesce(volume, 0), 9) AS volume, coalesce(n_facets, 0)::INTEGER AS n_facets, CASE WHEN volume IS NULL THEN 2 ELSE 0 END::INTEGER AS status FROM seeds s LEFT JOIN cells USING (cell_id)",
    "volume_difference": f"SELECT round(avg(e), 9) AS mean_error, round(max(e), 8) AS max_error, count(*) FILTER (e > 1e-3) AS large FROM (SELECT abs(n.volume - o.volume) / o.volume AS e FROM (WITH {_VORONOI_MOVED} SELECT * FROM cells) n JOIN (WITH {_VORONOI} SELECT * FROM cells) o USING (cell_id))",
    "neighbour_changes": f"SELECT count(*) FILTER (n.cell_id IS NULL) AS missing, count(*) FILTER (o.cell_id IS NULL) AS extra FROM (WITH {_VORONOI_MOVED} SELECT cell_id, nbr_id FROM facets WHERE nbr_id >= 0) n FULL JOIN (WITH {_VORONOI} SELECT cell_id, nbr_id FROM facets WHERE nbr_id >= 0) o ON n.cell_id = o.cell_id AND n.nbr_id = o.nbr_id",
    "skin_histogram": f"WITH {_SEEDS}, {_MOVED}, {_DISP}, {_AROUND} SELECT bin, n FROM near",
    "dilated_movers": f"WITH {_SEEDS}, {_MOVED}, {_DISP}, {_AROUND} SELECT cell_id FROM moved WHERE ({_bin('x', 5)} + 5 * ({_bin('y', 5)} + 5 * {_bin('z', 5)})) IN (SELECT bin FROM near WHERE n >= 70)",
    "mover_partners": f"WITH {_VORONOI}, {_MOVED}, {_DISP}, m AS (SELECT cell_id FROM disp WHERE moved2 > ({1.4 * SKIN!r}::DOUBLE / 2) ** 2) SELECT DISTINCT nbr_id AS cell_id FROM facets SEMI JOIN m USING (cell_id) WHERE nbr_id >= 0 AND area > 1e-7 AND nbr_id NOT IN (SELECT cell_id FROM m)",
    "candidate_sets": f"WITH {_SEEDS}, {_PAIRS} SELECT cell_id, string_agg(nbr_id::VARCHAR, ' ' ORDER BY nbr_id) AS candidates FROM pairs WHERE d2 <= {RADIUS!r}::DOUBLE * {RADIUS!r}::DOUBLE GROUP BY cell_id",
    "halo_refresh": f"WITH h AS ({_halo()}), {_MOVED} SELECT block, cell_id, is_owned, round(x, 12) AS x FROM h JOIN moved USING (cell_id)",
    "sphere_distances": f"WITH {_SEEDS} SELECT cell_id, round(sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) + (z - 0.5) * (z - 0.5)) - 0.25, 12) AS distance FROM seeds",
    "cell_polyhedra": f"WITH {_VORONOI} SELECT cell_id, points::INTEGER AS points, n_facets::INTEGER AS faces, round(volume, 9) AS volume FROM cells JOIN (SELECT cell_id, count(*) AS points FROM corners GROUP BY cell_id) USING (cell_id)",
    "cell_sections": f"WITH {_VORONOI}, {_CUT} SELECT cell_id, round(sum(x * ey - ex * y) / 2, 8) AS area, count(*)::INTEGER AS sides FROM turn GROUP BY cell_id HAVING count(*) >= 3",
    "moving_step": f"WITH {_VORONOI_MOVED} SELECT cell_id, round(volume, 6) AS volume, n_facets::INTEGER AS n_facets FROM cells",
}

QUERIES = {
    f.__name__: f
    for f in (seed_binning, morton_code, neighbor_range_join, knn_closest_first, nearest_seed_assignment, block_halo_replication, voronoi_cells, voronoi_facets, transport_laplacian,
              tessellation_invariants, pressure_force, internal_energy, interface_energy, velocity_gradient, viscous_force, kinetic_energy, power_cells, power_buried, verlet_movers,
              max_displacement, spheres_sdf, walled_cells, cell_sections, cell_polyhedra, moving_step, fluid_steps, volume_mesh, interface_mesh,
              wrapped_positions, plane_offsets, reach_bounds, neighbor_counts, max_facets, facet_offsets, reciprocal_facets, volume_gradient, stress_tensor, volume_difference, neighbour_changes,
              skin_histogram, dilated_movers, mover_partners, candidate_sets, halo_refresh, sphere_distances)
}

__all__ = ["QUERIES", "SQL"]

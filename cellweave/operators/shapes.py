"""Polyhedra and plane sections of cells, from their corners: joins, windows and sorts."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..box import Box
from ..plans import nearest
from .clip import Cells, clip_against_solid
from .tessellate import CELLS, EMPTY, INCOMPLETE, OK, as_table, clip_by_neighbours, corners_of, planes_of, tessellate
from .walls import PeriodicSpheres


def edges_of(cells: DataFrame) -> DataFrame:
    """A row per edge: its two planes ``a < b`` and its two ends relative to the seed."""
    q = corners_of(cells)
    pairs = [F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))]
    ends = q.select("cell_id", "corner", "x", "y", "z", F.explode(F.array(*pairs)).alias("e")).select("cell_id", "e.*", F.struct("corner", "x", "y", "z").alias("p"))
    both = ends.groupBy("cell_id", "a", "b").agg(F.min("p").alias("p"), F.max("p").alias("q"), F.count("*").alias("n")).where("n = 2")
    return both.select("cell_id", "a", "b", *[F.col(f"p.{c}").alias(f"p{c}") for c in "xyz"], *[F.col(f"q.{c}").alias(f"q{c}") for c in "xyz"])


def _in_order(points: DataFrame, keys: list[str], normal: tuple[str, str, str]) -> DataFrame:
    """Points of convex polygons (columns px, py, pz) ordered about their middle: ``rank`` from 0,
    counter-clockwise seen against the normal."""
    w = Window.partitionBy(*keys)
    n = [F.col(c) for c in normal]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    n = [c / size for c in n]
    out = points.withColumns({f"m{c}": F.avg(f"p{c}").over(w) for c in "xyz"})
    # two directions across the normal: off the axis that it is least along
    flat = F.abs(n[0]) < 0.6
    u = [F.when(flat, F.lit(0.0)).otherwise(-n[2]), F.when(flat, n[2]).otherwise(F.lit(0.0)), F.when(flat, -n[1]).otherwise(n[0])]
    v = [n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0]]
    d = [F.col(f"p{c}") - F.col(f"m{c}") for c in "xyz"]
    angle = F.atan2(d[0] * v[0] + d[1] * v[1] + d[2] * v[2], d[0] * u[0] + d[1] * u[1] + d[2] * u[2])
    out = out.withColumn("angle", angle)
    return out.withColumn("rank", F.row_number().over(w.orderBy("angle")) - 1).drop("mx", "my", "mz", "angle")


def faces_of(cells: DataFrame) -> DataFrame:
    """``cell_id, k, nbr_id, ring``: each face's corner numbers in order, counter-clockwise from outside."""
    q = corners_of(cells)
    on = q.select("cell_id", "corner", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.explode(F.array("a", "b", "c")).alias("k"))
    on = on.join(planes_of(cells), ["cell_id", "k"])
    ring = _in_order(on, ["cell_id", "k"], ("nx", "ny", "nz"))
    out = ring.groupBy("cell_id", "k", "nbr_id").agg(F.array_sort(F.collect_list(F.struct("rank", "corner"))).alias("r"))
    return out.where(F.size("r") >= 3).select("cell_id", "k", "nbr_id", F.transform("r", lambda s: s["corner"]).alias("ring"))


def polyhedra(cells: DataFrame) -> DataFrame:
    """``cell_id, points, faces, volume, boundary``: points in the box's frame (not wrapped), faces as
    rings of point numbers, whether any face is a wall."""
    faces = faces_of(cells).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("k", "nbr_id", "ring"))).alias("f"))
    points = F.transform("corners", lambda q: F.struct((F.col("x") + q["x"]).alias("x"), (F.col("y") + q["y"]).alias("y"), (F.col("z") + q["z"]).alias("z")))
    out = cells.where("volume > 0").select("cell_id", points.alias("points"), "volume").join(faces, "cell_id")
    return out.select("cell_id", "points", F.transform("f", lambda s: s["ring"]).alias("faces"), "volume", F.exists("f", lambda s: s["nbr_id"] == -2).alias("boundary"))


def sections(cells: DataFrame, origin: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """``cell_id, polygon, volume, area``: each cell cut by the plane through ``origin``: where its edges
    cross it, in order."""
    n = [float(c) for c in normal]
    size = sum(c * c for c in n) ** 0.5
    n = [c / size for c in n]
    # only cells that reach the plane: their corners lie within sqrt(r2_max) of the seed
    height = sum((F.col(c) - o) * k for c, o, k in zip("xyz", [float(c) for c in origin], n))
    cells = cells.where(height * height <= F.col("r2_max") * (1 + 1e-9))
    seeds = cells.select("cell_id", *[F.col(c).alias(f"s{c}") for c in "xyz"], "volume")
    e = edges_of(cells).join(seeds, "cell_id")
    side = lambda p: sum(((F.col(f"s{c}") + F.col(f"{p}{c}") - o) * k for c, o, k in zip("xyz", origin, n)), F.lit(0.0))
    e = e.withColumn("dp", side("p")).withColumn("dq", side("q")).where("(dp > 0) <> (dq > 0)")
    t = F.col("dp") / (F.col("dp") - F.col("dq"))
    cut = e.select("cell_id", "volume", *[(F.col(f"s{c}") + F.col(f"p{c}") + t * (F.col(f"q{c}") - F.col(f"p{c}"))).alias(f"p{c}") for c in "xyz"], *[F.lit(k).alias(f"n{c}") for c, k in zip("xyz", n)])
    ring = _in_order(cut, ["cell_id"], ("nx", "ny", "nz"))
    w = Window.partitionBy("cell_id").orderBy("rank")
    nxt = {f"e{c}": F.coalesce(F.lead(f"p{c}").over(w), F.first(f"p{c}").over(w)) for c in "xyz"}
    ring = ring.withColumns(nxt)
    twice = (F.col("py") * F.col("ez") - F.col("pz") * F.col("ey")) * n[0] + (F.col("pz") * F.col("ex") - F.col("px") * F.col("ez")) * n[1] + (F.col("px") * F.col("ey") - F.col("py") * F.col("ex")) * n[2]
    out = ring.groupBy("cell_id", "volume").agg((F.sum(twice) / 2).alias("area"), F.array_sort(F.collect_list(F.struct("rank", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z")))).alias("r"))
    return out.where(F.size("r") >= 3).select("cell_id", F.transform("r", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z"))).alias("polygon"), "volume", "area")


def walled_cells(seeds: DataFrame, centres, radii, box: Box | float = 1.0) -> DataFrame:
    """Cells of seeds in the pores of a periodic sphere packing."""
    box = Box.of(box)
    return tessellate(seeds, box, sdf=PeriodicSpheres(tuple(map(tuple, centres)), tuple(radii), box))


def walled_polyhedra(seeds: DataFrame, centres, radii, box: Box | float = 1.0) -> DataFrame:
    return polyhedra(walled_cells(seeds, centres, radii, box))


def walled_sections(seeds: DataFrame, centres, radii, origin, normal, box: Box | float = 1.0) -> DataFrame:
    return sections(walled_cells(seeds, centres, radii, box), origin, normal)


def pore_cells(seeds: DataFrame, which: DataFrame, centres, radii, box: Box | float = 1.0, k: int = 80) -> DataFrame:
    """The cells, schema ``CELLS``, of the seeds that ``which(cell_id)`` names, each from its ``k`` nearest
    seeds alone, in the pores of a periodic sphere packing; nothing else is tessellated.

    A cell that seeds further than the kth, or than half an edge, could still cut has status INCOMPLETE, a seed inside a
    sphere has an empty cell.  Ids that ``seeds`` doesn't hold, and nulls, give no row; a repeated id
    gives one."""
    box = Box.of(box)
    solid = PeriodicSpheres(tuple(map(tuple, centres)), tuple(radii), box)
    rows = seeds.select(F.col("cell_id").cast("long").alias("cell_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).dropna()
    own, n = rows.join(which.select("cell_id").distinct(), "cell_id", "left_semi"), rows.count()
    near = nearest(own, rows, box, k, n).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr_id", "rx", "ry", "rz"))).alias("near"))
    edges = box.edges

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, pos = b["cell_id"].to_numpy(), np.stack([b[c].to_numpy() for c in "xyz"], 1)
            lists = b["near"]
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)
            flat, m = lists.flatten(), len(ids)
            lane = np.repeat(np.arange(m), counts)
            at = np.arange(len(lane)) - np.repeat(np.cumsum(counts) - counts, counts)
            width = max(1, int(counts.max(initial=0)))
            rel, nbr = np.full((m, width, 3), np.inf), np.full((m, width), -1)
            rel[lane, at] = np.stack([flat.field(f"r{c}").to_numpy() for c in "xyz"], 1)
            nbr[lane, at] = flat.field("nbr_id").to_numpy()
            cells = Cells(m, edges)
            clip_by_neighbours(cells, np.arange(m), rel, nbr, None, None, 0.0, False)
            clip_against_solid(cells, pos, solid)
            last = np.where(counts < n - 1, (rel[np.arange(m), np.maximum(counts, 1) - 1] ** 2).sum(1), np.inf)
            status = np.where(4 * cells.r2 > np.minimum(last, (edges.min() / 2) ** 2), INCOMPLETE, OK)
            status[cells.nt == 0] = EMPTY
            yield from as_table(cells, status, pos, ids, None, True).to_batches()

    return own.join(near, "cell_id", "left").mapInArrow(run, CELLS)

"""Volume meshes on the cluster: vectors are tables of a row for each seed, products are joins and
sums, and the driver holds a few numbers.

A Gauss-Newton step solves J' D J s = -g, where J has a row for each cell and three columns for each
seed.  J's entries are kept twice, as arrays by cell and as arrays by seed, each laid out by its key
once for a Newton step, so that a product moves only a vector's rows and partial sums: by seed, an
entry times the seed's vector goes to its cell; by cell, back.  Each iteration of conjugate gradients
is one table in the shared folder and one row of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..box import Box
from ..plans import drop_staged, staged
from .tessellate import facets_of, tessellate

AXES = ("x", "y", "z")


@dataclass
class MeshTable:
    """``positions``: ``cell_id, x, y, z, volume``; how the optimiser ended."""

    positions: DataFrame
    iters: int
    converged: bool
    energy: float
    max_vol_err: float
    mean_vol_err: float
    n_empty: int


def _dot(a: str, b: str) -> Column:
    return sum((F.col(f"{a}{c}") * F.col(f"{b}{c}") for c in AXES), F.lit(0.0))


def _sums(df: DataFrame, **values: Column):
    row = df.agg(*[F.sum(v).alias(k) for k, v in values.items()]).first()
    return [float(v or 0) for v in row]


class Jacobian:
    """dV/dx of staged cells (``cell_id, volume, ref, facets``): a cell without walls moves with its
    seeds, so its derivative by its own seed is what is left of its neighbours'."""

    def __init__(self, cells: DataFrame, parts: int):
        entries = facets_of(cells).where("nbr_id >= 0").select("cell_id", F.col("nbr_id").alias("seed"), *[F.col(f"v{c}").alias(f"e{c}") for c in AXES])
        own = entries.groupBy("cell_id").agg(*[(-F.sum(f"e{c}")).alias(f"e{c}") for c in AXES]).select("cell_id", F.col("cell_id").alias("seed"), *[f"e{c}" for c in AXES])
        self.entries = staged(entries.union(own), "jacobian")
        self.by_cell = self._arrays("cell_id", "seed", parts)
        self.by_seed = self._arrays("seed", "cell_id", parts)

    def _arrays(self, key: str, other: str, parts: int) -> DataFrame:
        row = F.struct(F.col(other).alias("to"), *[f"e{c}" for c in AXES])
        # lineage ends at the staged entries: a lost part is made again from them
        return self.entries.repartition(parts, key).groupBy(key).agg(F.collect_list(row).alias("row")).withColumnRenamed(key, "at").persist()

    def drop(self) -> None:
        self.by_cell.unpersist()
        self.by_seed.unpersist()
        drop_staged(self.entries)

    def forward(self, vector: DataFrame) -> DataFrame:
        """``cell_id, value``: J times ``cell_id, px, py, pz``."""
        met = self.by_seed.join(vector.withColumnRenamed("cell_id", "at").hint("shuffle_hash"), "at").select("px", "py", "pz", F.inline("row"))
        return met.groupBy(F.col("to").alias("cell_id")).agg(F.sum(_dot("e", "p")).alias("value"))

    def back(self, values: DataFrame, square: bool = False) -> DataFrame:
        """``cell_id, gx, gy, gz``: the transpose times ``cell_id, value``; with ``square``, entries squared."""
        met = self.by_cell.join(values.withColumnRenamed("cell_id", "at").hint("shuffle_hash"), "at").select("value", F.inline("row"))
        term = lambda c: F.col(f"e{c}") * F.col(f"e{c}") if square else F.col(f"e{c}")
        return met.groupBy(F.col("to").alias("cell_id")).agg(*[F.sum(term(c) * F.col("value")).alias(f"g{c}") for c in AXES])


def _solve(j: Jacobian, start: DataFrame, curve: DataFrame, iters: int, tol: float) -> DataFrame:
    """``cell_id, s*``: conjugate gradients with the diagonal as preconditioner.

    start: ``cell_id, d* (diagonal), r* (right side)``; curve: ``cell_id, curve`` (of each cell)."""
    zero = [F.lit(0.0).alias(f"s{c}") for c in AXES]
    v = start.select("cell_id", *[f"{k}{c}" for k in "dr" for c in AXES], *zero, *[(F.col(f"r{c}") / F.col(f"d{c}")).alias(f"p{c}") for c in AXES])
    held, size = None, None
    for _ in range(iters):
        along = j.forward(v.select("cell_id", "px", "py", "pz")).join(curve, "cell_id").select("cell_id", (F.col("value") * F.col("curve")).alias("value"))
        hp = j.back(along)
        now = v.join(hp, "cell_id").select(*v.columns, *[(F.col(f"g{c}") + 1e-10 * F.col(f"d{c}") * F.col(f"p{c}")).alias(f"h{c}") for c in AXES])
        now = staged(now, "cg")
        if held is not None:
            drop_staged(held)
        held = now
        scaled = lambda a, b: sum((F.col(f"{a}{c}") * F.col(f"{b}{c}") / F.col(f"d{c}") for c in AXES), F.lit(0.0))
        ph, rz, rh, hh, rr, r_h, h_h = _sums(now, ph=_dot("p", "h"), rz=scaled("r", "r"), rh=scaled("r", "h"), hh=scaled("h", "h"), rr=_dot("r", "r"), r_h=_dot("r", "h"), h_h=_dot("h", "h"))
        size = rr if size is None else size
        if ph <= 0:
            return now.select("cell_id", "sx", "sy", "sz")
        t = rz / ph
        turn = max(0.0, rz - 2 * t * rh + t * t * hh) / rz  # the next residual's size before it is made
        move = {f"s{c}": F.col(f"s{c}") + t * F.col(f"p{c}") for c in AXES}
        rest = {c: F.col(f"r{c}") - t * F.col(f"h{c}") for c in AXES}
        v = now.select("cell_id", *[f"d{c}" for c in AXES], *[rest[c].alias(f"r{c}") for c in AXES], *[e.alias(k) for k, e in move.items()],
                       *[(rest[c] / F.col(f"d{c}") + turn * F.col(f"p{c}")).alias(f"p{c}") for c in AXES])
        if rr - 2 * t * r_h + t * t * h_h <= tol * tol * size:
            break
    return v.select("cell_id", "sx", "sy", "sz")


def volume_mesh(seeds: DataFrame, box: Box | float = 1.0, max_newton: int = 60, tol: float = 1e-9, cg_iters: int = 300) -> MeshTable:
    """Moves ``seeds(cell_id, x, y, z, ref)`` so that volumes approach ``ref``: the sum of
    (V / ref - 1)^2 by Gauss-Newton steps with Armijo line search, until no component of the gradient
    exceeds ``tol``.  The same steps as ``optimize_volume_mesh`` with its defaults, for any number of
    seeds; ids must differ, rows with nulls take no part, and an empty table stays empty.
    """
    box = Box.of(box)
    spark = seeds.sparkSession
    x = staged(seeds.select(F.col("cell_id").cast("long").alias("cell_id"), *[F.col(c).cast("double").alias(c) for c in (*AXES, "ref")]).dropna(), "mesh")
    n = x.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 50_000 + 1)
    miss = F.col("volume") / F.col("ref") - 1

    def evaluated(at: DataFrame) -> tuple[DataFrame, float]:
        cells = tessellate(at.select("cell_id", *AXES), box, topology=False).select("cell_id", "volume", "facets")
        cells = staged(cells.join(at.select("cell_id", *AXES, "ref"), "cell_id"), "mesh-cells")
        return cells, _sums(cells, e=miss * miss)[0]

    def finished(cells, it, converged, energy):
        worst, mean, empty = cells.agg(F.max(F.abs(F.col("volume") - F.col("ref"))), F.avg(F.abs(F.col("volume") - F.col("ref"))), F.count_if(F.col("volume") <= 0)).first()
        return MeshTable(cells.select("cell_id", *AXES, "volume"), it, converged, energy, float(worst or 0), float(mean or 0), int(empty))

    cells, energy = evaluated(x)
    for it in range(max_newton + 1):
        j = Jacobian(cells, parts)
        slopes = cells.select("cell_id", (2 * miss / F.col("ref")).alias("value"))
        curve = cells.select("cell_id", (2 / (F.col("ref") * F.col("ref"))).alias("curve"))
        diagonal = j.back(curve.withColumnRenamed("curve", "value"), square=True).select("cell_id", *[(F.col(f"g{c}") + 1e-12).alias(f"d{c}") for c in AXES])
        start = staged(j.back(slopes).join(diagonal, "cell_id").select("cell_id", *[f"d{c}" for c in AXES], *[(-F.col(f"g{c}")).alias(f"r{c}") for c in AXES]), "gradient")
        steepest = start.agg(F.max(F.greatest(*[F.abs(f"r{c}") for c in AXES]))).first()[0]
        if steepest is None or steepest < tol or it == max_newton:
            j.drop()
            return finished(cells, it, steepest is None or steepest < tol, energy)
        step = staged(_solve(j, start, curve, cg_iters, 1e-10).join(start.select("cell_id", *[f"r{c}" for c in AXES]), "cell_id"), "step")
        j.drop()
        longest, slope = step.agg(F.sqrt(F.max(_dot("s", "s"))), -F.sum(_dot("s", "r"))).first()
        t = min(1.0, 0.25 * box.spacing(n) / longest) if longest else 1.0
        for _ in range(24):
            moved = cells.select("cell_id", *AXES, "ref").join(step, "cell_id", "left")
            at = {c: F.col(c) + t * F.coalesce(F.col(f"s{c}"), F.lit(0.0)) for c in AXES}
            moved = staged(moved.select("cell_id", *[(at[c] - e * F.floor(at[c] / e)).alias(c) for c, e in zip(AXES, box.edges.tolist())], "ref"), "mesh")
            tried, cost = evaluated(moved)
            drop_staged(moved)
            if cost <= energy + 1e-4 * t * slope:
                break
            drop_staged(tried)
            t /= 2
        else:
            return finished(cells, it, False, energy)
        drop_staged(step)
        drop_staged(start)
        drop_staged(cells)
        cells, energy = tried, cost
    raise AssertionError("the loop returns")

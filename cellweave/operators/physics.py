"""Finite-volume physics on cells and facets: joins and sums.

``facets`` is what ``tessellate.facets_of`` gives; (vx, vy, vz) is the derivative of the cell's volume
by the neighbour's position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..box import Box
from ..functions import eos_pressure, wrap
from ..plans import drop_staged, reciprocal, staged
from .moving import Moving
from .tessellate import facets_of, tessellate

AXES = "xyz"


def both_sides(cells: DataFrame, *values: str) -> DataFrame:
    """Facets with the reciprocal facet (``back_*``) and values of the own (``i_*``) and the
    neighbour cell (``j_*``); facets without a reciprocal keep nulls on that side."""
    f = facets_of(cells).select("cell_id", "nbr_id", "vx", "vy", "vz", "area")
    back = f.select(F.col("cell_id").alias("bc"), F.col("nbr_id").alias("bn"), *[F.col(f"v{c}").alias(f"back_v{c}") for c in AXES])
    f = f.join(back, (F.col("cell_id") == F.col("bn")) & (F.col("nbr_id") == F.col("bc")), "left").drop("bn")
    own = cells.select(F.col("cell_id"), *[F.col(v).alias(f"i_{v}") for v in values])
    other = cells.select(F.col("cell_id").alias("oc"), *[F.col(v).alias(f"j_{v}") for v in values])
    return f.join(own, "cell_id").join(other, F.col("bc") == F.col("oc"), "left").drop("oc")


def pressure_force(cells: DataFrame, pressure: float, mean_volume: float) -> DataFrame:
    """``cell_id, fx, fy, fz``: the sum over facets of p_j dV_j/dx_i - p_i dV_i/dx_j; a facet without
    a reciprocal keeps its own term."""
    f = both_sides(cells.withColumn("p", eos_pressure(F.col("volume"), pressure, mean_volume)), "p")
    sums = [F.sum(F.coalesce(F.col("j_p") * F.col(f"back_v{c}"), F.lit(0.0)) - F.col("i_p") * F.col(f"v{c}")).alias(f"f{c}") for c in AXES]
    return f.groupBy("cell_id").agg(*sums)


def velocity_gradient(cells: DataFrame) -> DataFrame:
    """``cell_id`` and ``g_pk``, the derivative of velocity p along k (Green-Gauss); cells also hold
    ``ux, uy, uz``."""
    f = both_sides(cells, "ux", "uy", "uz", "volume").where(F.col("bc").isNotNull())
    sums = [F.sum(F.col(f"i_u{p}") * F.col(f"v{k}") - F.col(f"j_u{p}") * F.col(f"back_v{k}")).alias(f"s_{p}{k}") for p in AXES for k in AXES]
    g = f.groupBy("cell_id", "i_volume").agg(*sums)
    return g.select("cell_id", *[(F.col(f"s_{p}{k}") / F.col("i_volume")).alias(f"g_{p}{k}") for p in AXES for k in AXES])


def stress(gradient: DataFrame, viscosity: Column, bulk: Column) -> DataFrame:
    """Newtonian stress ``t_km`` of each cell from its velocity gradient."""
    div = F.col("g_xx") + F.col("g_yy") + F.col("g_zz")
    lam = (bulk - 2.0 / 3.0 * viscosity) * div
    term = lambda k, m: viscosity * (F.col(f"g_{k}{m}") + F.col(f"g_{m}{k}")) + (lam if k == m else F.lit(0.0))
    return gradient.select("cell_id", *[term(k, m).alias(f"t_{k}{m}") for k in AXES for m in AXES])


def viscous_force(cells: DataFrame, tensor: DataFrame) -> DataFrame:
    """``cell_id, fx, fy, fz``: the sum over facets of (t_j - t_i) . dV."""
    f = facets_of(cells).where("nbr_id >= 0").select("cell_id", "nbr_id", "vx", "vy", "vz")
    own = tensor.select("cell_id", *[F.col(c).alias(f"i_{c}") for c in tensor.columns if c != "cell_id"])
    other = tensor.select(F.col("cell_id").alias("nbr_id"), *[F.col(c).alias(f"j_{c}") for c in tensor.columns if c != "cell_id"])
    f = f.join(own, "cell_id").join(other, "nbr_id")
    part = lambda k: sum(((F.col(f"j_t_{k}{m}") - F.col(f"i_t_{k}{m}")) * F.col(f"v{m}") for m in AXES), F.lit(0.0))
    return f.groupBy("cell_id").agg(*[F.sum(part(k)).alias(f"f{k}") for k in AXES])


def kinetic_energy(bodies: DataFrame, mass: str = "mass") -> DataFrame:
    return bodies.agg((0.5 * F.sum(F.col(mass) * (F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz")))).alias("kinetic_energy"))


def internal_energy(cells: DataFrame, pressure: float, mean_volume: float) -> DataFrame:
    return cells.agg((-F.sum(F.lit(pressure) * mean_volume * F.log(F.col("volume") / mean_volume))).alias("internal_energy"))


def interface_energy(cells: DataFrame, phases: DataFrame, tension: DataFrame) -> DataFrame:
    """Sum of tension times area over facets from a phase to a lesser one, phase 0 skipped.

    phases: ``cell_id, phase``; tension: ``phase_i, phase_j, tension``, a row for each pair."""
    f = facets_of(cells).where("nbr_id >= 0").select("cell_id", "nbr_id", "area")
    f = f.join(phases.select("cell_id", F.col("phase").alias("phase_i")), "cell_id").join(phases.select(F.col("cell_id").alias("nbr_id"), F.col("phase").alias("phase_j")), "nbr_id")
    f = f.where((F.col("phase_i") != 0) & (F.col("phase_j") < F.col("phase_i"))).join(tension, ["phase_i", "phase_j"])
    return f.agg(F.coalesce(F.sum(F.col("tension") * F.col("area")), F.lit(0.0)).alias("interface_energy"))


def invariants(cells: DataFrame, box: Box | float) -> DataFrame:
    """One row: volume_error, area_asymmetry, area_sum, dv_sum, one_sided."""
    f = facets_of(cells)
    back = f.select(F.col("cell_id").alias("bc"), F.col("nbr_id").alias("bn"), *[F.col(f"a{c}").alias(f"b{c}") for c in AXES])
    pair = f.where("nbr_id >= 0").join(back, (F.col("cell_id") == F.col("bn")) & (F.col("nbr_id") == F.col("bc")), "left")
    off = sum((F.pow(F.col(f"a{c}") + F.col(f"b{c}"), 2) for c in AXES), F.lit(0.0))
    size = sum((F.pow(F.col(f"a{c}"), 2) for c in AXES), F.lit(0.0))
    one = pair.agg(F.max(F.sqrt(off / size)).alias("area_asymmetry"), F.count_if(F.col("bc").isNull()).alias("one_sided"))
    norm = lambda p: F.sqrt(sum((F.pow(F.sum(f"{p}{c}"), 2) for c in AXES), F.lit(0.0)))
    two = f.agg(norm("a").alias("area_sum"), norm("v").alias("dv_sum"))
    three = cells.agg((F.abs(F.sum("volume") - Box.of(box).volume) / Box.of(box).volume).alias("volume_error"))
    k = F.lit(1).alias("k")  # one row each
    return three.withColumn("k", k).join(one.withColumn("k", k), "k").join(two.withColumn("k", k), "k").drop("k")


def seed_gradient(cells: DataFrame, by_volume: Column) -> DataFrame:
    """``cell_id, gx, gy, gz``: the gradient by each seed's position of a sum over cells whose derivative
    by a cell's volume is ``by_volume``; a cell without walls moves with its seeds, so that its own
    seed has what its neighbours have, with the other sign."""
    f = cells.select("cell_id", by_volume.alias("d"), F.inline("facets")).where("nbr_id >= 0")
    there = f.select(F.col("nbr_id").alias("cell_id"), *[(F.col("d") * F.col(f"v{c}")).alias(f"g{c}") for c in AXES])
    here = f.select("cell_id", *[(-F.col("d") * F.col(f"v{c}")).alias(f"g{c}") for c in AXES])
    return there.union(here).groupBy("cell_id").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in AXES])


def compare_volumes(cells: DataFrame, oracle: DataFrame, least: float = 1e-3) -> DataFrame:
    """Mean, greatest and number of large relative differences of ``volume`` by cell."""
    o = oracle.select("cell_id", F.col("volume").alias("other"))
    e = F.abs(F.col("volume") - F.col("other")) / F.col("other")
    return cells.join(o, "cell_id").where("other > 0").agg(F.avg(e).alias("mean_error"), F.max(e).alias("max_error"), F.count_if(e > least).alias("large"))


def compare_neighbours(cells: DataFrame, oracle: DataFrame) -> DataFrame:
    """Neighbour pairs that only one of two tessellations has: ``missing, extra``."""
    a, b = (facets_of(c).where("nbr_id >= 0").select("cell_id", "nbr_id", F.lit(1).alias(n)) for c, n in ((cells, "a"), (oracle, "b")))
    both = a.join(b, ["cell_id", "nbr_id"], "full")
    return both.agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"))


class Simulation:
    """A compressible isothermal fluid of moving cells, stepped by velocity Verlet.

    ``bodies``: ``cell_id, x, y, z, ux, uy, uz, mass[, viscosity[, bulk_viscosity]]``.  Every step is
    written to the shared folder, so lineage doesn't grow.  With ``repair``, cells are repaired
    from the last step instead of built anew.
    """

    def __init__(self, bodies: DataFrame, box: Box | float = 1.0, pressure: float = 1.0, repair: bool = False):
        self.box, self.pressure, self.repair, self.time = Box.of(box), pressure, repair, 0.0
        cols = bodies.columns
        viscosity = F.col("viscosity").cast("double") if "viscosity" in cols else F.lit(0.0)
        bulk = F.col("bulk_viscosity").cast("double") if "bulk_viscosity" in cols else F.lit(0.0)
        number = ["x", "y", "z", "ux", "uy", "uz", "mass"]
        self.viscous = "viscosity" in cols
        self.bodies = staged(bodies.select(F.col("cell_id").cast("long").alias("cell_id"), *[F.col(c).cast("double").alias(c) for c in number], viscosity.alias("viscosity"), bulk.alias("bulk_viscosity")), "bodies")
        self.n = self.bodies.count()
        self.mean_volume = self.box.volume / max(self.n, 1)
        self.moving: Moving | None = None

    def init(self) -> "Simulation":
        if self.repair:
            self.moving = Moving(self.box).build(self.bodies)
        self._forces()
        return self

    def _forces(self) -> None:
        if self.moving is not None:
            self.cells = self.moving.cells
        else:
            self.cells = staged(tessellate(self.bodies, self.box, topology=False), "cells")
        force = pressure_force(self.cells, self.pressure, self.mean_volume)
        if self.viscous:
            with_u = self.cells.join(self.bodies.select("cell_id", "ux", "uy", "uz", "viscosity", "bulk_viscosity"), "cell_id")
            grad = velocity_gradient(with_u).join(self.bodies.select("cell_id", "viscosity", "bulk_viscosity"), "cell_id")
            extra = viscous_force(self.cells, stress(grad, F.col("viscosity"), F.col("bulk_viscosity")))
            force = force.union(extra).groupBy("cell_id").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in AXES])
        self.forces = staged(force, "forces")

    def step(self, steps: int = 1, dt: float = 1e-3) -> "Simulation":
        def kicked(rows: DataFrame) -> DataFrame:
            half = rows.join(self.forces, "cell_id", "left")
            return half.withColumns({f"u{c}": F.col(f"u{c}") + F.coalesce(F.col(f"f{c}"), F.lit(0.0)) / F.col("mass") * (dt / 2) for c in AXES}).drop("fx", "fy", "fz")

        for _ in range(steps):
            moved = kicked(self.bodies)
            self.bodies = staged(moved.withColumns({c: wrap(F.col(c) + F.col(f"u{c}") * dt, e) for c, e in zip(AXES, self.box.edges.tolist())}), "bodies")
            if self.moving is not None:
                self.moving.step(self.bodies)
            drifted, old = self.bodies, self.forces
            self._forces()
            self.bodies = staged(kicked(drifted), "bodies")
            for done in (drifted, old):  # nobody has seen them, or they are past
                drop_staged(done)
            self.time += dt
        return self

    def positions(self) -> DataFrame:
        return self.bodies.select("cell_id", "x", "y", "z")

    def velocities(self) -> DataFrame:
        return self.bodies.select("cell_id", "ux", "uy", "uz")

    def volumes(self) -> DataFrame:
        return self.cells.select("cell_id", "volume")

    def neighbor_counts(self) -> DataFrame:
        return self.cells.select("cell_id", "n_facets")

    @property
    def num_particles(self) -> int:
        return self.n

    def kinetic_energy(self) -> float:
        return kinetic_energy(self.bodies).first()[0]

    def internal_energy(self) -> float:
        return internal_energy(self.cells, self.pressure, self.mean_volume).first()[0]


__all__ = ["Simulation", "both_sides", "compare_neighbours", "compare_volumes", "interface_energy", "internal_energy", "invariants", "kinetic_energy", "pressure_force", "reciprocal", "seed_gradient", "stress", "velocity_gradient", "viscous_force"]

"""Tessellations of moving points: repair what a step has broken, or build anew.

The state is the table of cells with their planes and corners.  After a step, every cell's planes are
evaluated for the new positions; a cell is flagged if a corner pokes through one of its other
planes by more than a tolerance, or if its seed has moved further than half the skin since its last
build.  Flagged cells, the neighbours whose planes were poked, and then the new neighbours of
movers are built again among all seeds; verified; and if that doesn't settle, or too many are
flagged, everything is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..box import Box
from ..functions import min_image as min_image_col
from ..functions import bin_id, bin_index
from ..plans import block_grid, replicated, staged
from .clip import Cells, min_image
from .tessellate import CELLS, as_table, facets_of, tessellate


def unpacked(t: pa.Table, box: np.ndarray) -> Cells:
    """The kernel's cells of topology rows."""
    planes, corners = t["planes"].combine_chunks(), t["corners"].combine_chunks()
    n = len(t)
    c = Cells(0, box)
    po, co = np.asarray(planes.offsets), np.asarray(corners.offsets)
    c.n, c.count, c.nt = n, np.diff(po).astype(np.int64), np.diff(co).astype(np.int64)
    width, top = max(6, int(c.count.max(initial=6))), max(8, int(c.nt.max(initial=8)))
    c.u, c.h, c.id = np.zeros((n, width, 3)), np.zeros((n, width)), np.full((n, width), -1, np.int64)
    c.tri, c.v = np.zeros((n, top, 3), np.int32), np.zeros((n, top, 3))
    lane = np.repeat(np.arange(n), c.count)
    k = np.arange(len(lane)) - np.repeat(np.cumsum(c.count) - c.count, c.count)
    p = planes.flatten()
    c.id[lane, k], c.h[lane, k] = np.asarray(p.field("nbr_id")), np.asarray(p.field("off"))
    q = corners.flatten()
    cl = np.repeat(np.arange(n), c.nt)
    s = np.arange(len(cl)) - np.repeat(np.cumsum(c.nt) - c.nt, c.nt)
    for i, axis in enumerate("xyz"):
        c.u[lane, k, i] = np.asarray(p.field(f"n{axis}"))
        c.v[cl, s, i] = np.asarray(q.field(axis))
        c.tri[cl, s, i] = np.asarray(q.field("abc"[i]))
    c.r2 = np.zeros(n)
    return c


def reevaluate(c: Cells, pos: np.ndarray, own: np.ndarray, all_ids: np.ndarray, all_pos: np.ndarray, box: np.ndarray,
               w_own: np.ndarray | None = None, all_w: np.ndarray | None = None) -> np.ndarray:
    """Planes and corners of a fixed topology for new positions; which cells lack a neighbour's."""
    order = np.argsort(all_ids)
    at = np.minimum(np.searchsorted(all_ids[order], c.id), max(len(all_ids) - 1, 0))
    row = order[at]
    seed = (np.arange(c.u.shape[1]) < c.count[:, None]) & (c.id >= 0)
    absent = seed & (all_ids[row] != c.id)
    lane, k = np.nonzero(seed & ~absent)
    # the image that the plane was made by
    rel = c.u[lane, k] + min_image(all_pos[row[lane, k]] - pos[lane] - c.u[lane, k], box)
    c.u[lane, k] = rel
    c.h[lane, k] = (rel * rel).sum(1) / 2 + ((w_own[lane] - all_w[row[lane, k]]) / 2 if all_w is not None else 0)
    cl = np.repeat(np.arange(c.n), c.nt)
    s = np.arange(len(cl)) - np.repeat(np.cumsum(c.nt) - c.nt, c.nt)
    t = c.tri[cl, s]
    ua, ub, uc = (c.u[cl, t[:, i]] for i in range(3))
    ha, hb, hc = (c.h[cl, t[:, i]][:, None] for i in range(3))
    bc = np.cross(ub, uc)
    with np.errstate(divide="ignore", invalid="ignore"):
        c.v[cl, s] = (ha * bc + hb * np.cross(uc, ua) + hc * np.cross(ua, ub)) / (ua * bc).sum(1)[:, None]
    top = c.v.shape[1]
    c.r2 = np.where(np.arange(top) < c.nt[:, None], (c.v**2).sum(2), 0).max(1)
    del own
    return absent.any(1)


def poked(c: Cells, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell, plane) for each plane that a corner not on it pokes through by more than ``tol``."""
    length = np.sqrt((c.u**2).sum(2))
    length[length == 0] = 1
    out = np.full(c.h.shape, -np.inf)
    for s in range(c.v.shape[1]):
        d = (np.matmul(c.u, c.v[:, s, :, None])[:, :, 0] - c.h) / length
        d[np.arange(c.u.shape[1]) >= c.count[:, None]] = -np.inf
        for i in range(3):
            d[np.arange(c.n), c.tri[:, s, i]] = -np.inf
        d[c.nt <= s] = -np.inf
        d[~np.isfinite(d) & (d > 0)] = np.inf
        np.maximum(out, np.nan_to_num(d, nan=np.inf), out=out)
    return np.nonzero(out > tol)


class Moving:
    """The cells of a set of points that moves in steps; ``cells`` is the current table."""

    def __init__(self, box: Box | float = 1.0, tolerance: float = 1e-4, skin: float = 0.25, gate: bool = True, gate_share: float = 0.7, weighted: bool = False):
        self.box, self.tolerance, self.skin, self.gate, self.gate_share, self.weighted = Box.of(box), tolerance, skin, gate, gate_share, weighted

    def build(self, seeds: DataFrame) -> "Moving":
        self.n = seeds.count()
        self.spacing = self.box.spacing(self.n)
        self.cells = self._anew(seeds)
        return self

    def _anew(self, seeds: DataFrame) -> DataFrame:
        cells = tessellate(seeds, self.box, weighted=self.weighted)
        return staged(cells.withColumns({f"ref_{c}": F.col(c) for c in "xyz"}), "moving")

    def _evaluated(self, seeds: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """Cells of the stored topology at new positions, with ``flagged``, ``partners``, ``mover``."""
        state = self.cells if only is None else self.cells.join(only.select("cell_id"), "cell_id", "left_semi")
        box, tol, skin = self.box.edges, self.tolerance * self.spacing, self.skin * self.spacing
        grid = block_grid(self.box, self.n, 2_000, seeds.sparkSession.sparkContext.defaultParallelism)
        w = F.col("w").cast("double") if self.weighted else F.lit(0.0)
        rows = seeds.select(F.col("cell_id").cast("long").alias("cell_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], w.alias("w"))
        near = replicated(rows, self.box, grid, 4.5 * self.spacing)
        home = near.where("is_owned").select("cell_id", F.col("block").alias("home"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("w").alias("pw"))
        placed = state.join(home, "cell_id")
        weighted = self.weighted

        def work(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a):
                return pa.Table.from_pylist([], schema=arrow)
            a = a.sort_by("cell_id")
            pos = np.stack([a[f"p{c}"].to_numpy() for c in "xyz"], 1)
            ref = np.stack([a[f"ref_{c}"].to_numpy() for c in "xyz"], 1)
            c = unpacked(a, box)
            ids, w_own = a["cell_id"].to_numpy(), a["pw"].to_numpy() if weighted else None
            absent = reevaluate(c, pos, ids, b["cell_id"].to_numpy(), np.stack([b[k].to_numpy() for k in "xyz"], 1), box, w_own, b["w"].to_numpy() if weighted else None)
            lane, k = poked(c, tol)
            flagged = absent.copy()
            flagged[lane] = True
            if weighted:
                flagged |= c.nt == 0  # a buried cell may come back
            mover = (min_image(pos - ref, box) ** 2).sum(1) > (skin / 2) ** 2
            partner = c.id[lane, k]
            partners = [[] for _ in range(len(ids))]
            for i, p in zip(lane[partner >= 0], partner[partner >= 0]):
                partners[i].append(int(p))
            t = as_table(c, a["status"].to_numpy(), pos, ids, w_own, True)
            for i, axis in enumerate("xyz"):
                t = t.append_column(f"ref_{axis}", pa.array(ref[:, i]))
            for name, value in (("flagged", pa.array(flagged)), ("mover", pa.array(mover)), ("partners", pa.array(partners, pa.list_(pa.int64())))):
                t = t.append_column(name, value)
            return t

        schema = CELLS + ", ref_x double, ref_y double, ref_z double, flagged boolean, mover boolean, partners array<bigint>"
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromDDL(schema))
        return staged(placed.groupBy("home").cogroup(near.groupBy("block")).applyInArrow(work, schema), "evaluated")

    def step(self, seeds: DataFrame) -> dict[str, int]:
        """Advances to new positions of all seeds; the repair's counts."""
        stats = dict.fromkeys(("flagged", "pass1", "pass2", "rebuilt", "fell_back", "extra", "surgical", "verify_passes"), 0)
        now = self._evaluated(seeds)
        extra = ["flagged", "mover", "partners"]
        dirty = now.where("flagged or mover")
        stats["flagged"] = dirty.count()
        if not stats["flagged"]:
            self.cells = now.drop(*extra)
            return stats
        if self.gate and stats["flagged"] > self.gate_share * self.n:
            self.cells, stats["rebuilt"] = self._anew(seeds), 1
            return stats
        first = dirty.select("cell_id").union(now.where("flagged").select(F.explode("partners").alias("cell_id"))).distinct()
        movers = now.where("mover").select("cell_id")
        first = staged(first, "dirty")
        stats["pass1"] = first.count()
        built = self._rebuilt(seeds, first)
        met = facets_of(built).where("nbr_id >= 0").join(movers, "cell_id", "left_semi").select(F.col("nbr_id").alias("cell_id")).distinct()
        second = staged(met.join(first, "cell_id", "left_anti"), "dirty")
        stats["pass2"] = second.count()
        done = first
        if stats["pass2"]:
            built, done = built.union(self._rebuilt(seeds, second)), first.union(second)
        self.cells = staged(now.drop(*extra).join(done, "cell_id", "left_anti").union(built), "moving")
        for _ in range(2):
            stats["verify_passes"] += 1
            one_sided = self._one_sided()
            wrong = one_sided.count()
            if not wrong:
                return stats
            stats["extra"] += wrong
            self.cells = staged(self.cells.join(one_sided, "cell_id", "left_anti").union(self._rebuilt(seeds, one_sided)), "moving")
        if self._one_sided().isEmpty():
            return stats
        self.cells, stats["fell_back"] = self._anew(seeds), 1
        return stats

    def _rebuilt(self, seeds: DataFrame, which: DataFrame) -> DataFrame:
        cells = tessellate(seeds, self.box, weighted=self.weighted, only=which)
        return staged(cells.withColumns({f"ref_{c}": F.col(c) for c in "xyz"}), "rebuilt")

    def _one_sided(self) -> DataFrame:
        """Cells that a neighbour's facet names but that don't name it, or the other way round."""
        least = 1e-10 * self.spacing**2
        f = facets_of(self.cells).where((F.col("nbr_id") >= 0) & (F.col("area") > least)).select("cell_id", "nbr_id")
        back = f.select(F.col("nbr_id").alias("cell_id"), F.col("cell_id").alias("nbr_id"))
        all_of = facets_of(self.cells).where("nbr_id >= 0").select("cell_id", "nbr_id")
        odd = back.join(all_of, ["cell_id", "nbr_id"], "left_anti")
        return staged(odd.select("cell_id").union(odd.select(F.col("nbr_id").alias("cell_id"))).distinct(), "one-sided")

    def volumes(self) -> DataFrame:
        return self.cells.select("cell_id", "volume")

    def neighbor_counts(self) -> DataFrame:
        return self.cells.select("cell_id", "n_neighbors")


def displacement(now: DataFrame, reference: DataFrame, box: Box | float) -> DataFrame:
    """``cell_id, moved2``: squared displacement since a reference."""
    box = Box.of(box)
    ref = reference.select("cell_id", *[F.col(c).alias(f"ref_{c}") for c in "xyz"])
    d = [min_image_col(F.col(c) - F.col(f"ref_{c}"), e) for c, e in zip("xyz", box.edges.tolist())]
    return now.join(ref, "cell_id").select("cell_id", (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("moved2"))


def flag_movers(now: DataFrame, reference: DataFrame, box: Box | float, skin: float) -> DataFrame:
    return displacement(now, reference, box).where(F.col("moved2") > (skin / 2) ** 2).select("cell_id")


def max_displacement(now: DataFrame, reference: DataFrame, box: Box | float) -> DataFrame:
    return displacement(now, reference, box).agg(F.sqrt(F.max("moved2")).alias("max_displacement"))


def flagged_nearby(flagged: DataFrame, box: Box | float, grid: tuple[int, int, int]) -> DataFrame:
    """``bin, n``: how many of the flagged points lie in each bin of a periodic grid or one next to it;
    bins without any have no row."""
    box = Box.of(box)
    bins = [bin_index(F.col(c), e, n) for c, e, n in zip("xyz", box.edges.tolist(), grid)]
    out = flagged.select(*[b.alias(a) for a, b in zip("ijk", bins)]).groupBy("i", "j", "k").agg(F.count("*").alias("here"))
    for a, n in zip("ijk", grid):
        out = out.withColumn(a, F.explode(F.array_distinct(F.array(*[F.pmod(F.col(a) + d, F.lit(n)) for d in (-1, 0, 1)]))))
    key = F.col("i").cast("long") + grid[0] * (F.col("j") + F.lit(grid[1]).cast("long") * F.col("k"))
    return out.groupBy(key.alias("bin")).agg(F.sum("here").alias("n"))


def dilated(seeds: DataFrame, flagged: DataFrame, box: Box | float, grid: tuple[int, int, int], least: int) -> DataFrame:
    """``cell_id`` of the seeds in bins with ``least`` flagged points in them and the bins around."""
    box = Box.of(box)
    dense = flagged_nearby(flagged, box, grid).where(F.col("n") >= least)
    return seeds.withColumn("bin", bin_id(F.col("x"), F.col("y"), F.col("z"), box, grid)).join(dense, "bin", "left_semi").select("cell_id")


def partners(facets: DataFrame, flagged: DataFrame) -> DataFrame:
    """``cell_id`` of the seeds across a facet from a flagged cell that aren't flagged themselves."""
    across = facets.join(flagged.select("cell_id"), "cell_id", "left_semi").where("nbr_id >= 0").select(F.col("nbr_id").alias("cell_id")).distinct()
    return across.join(flagged.select("cell_id"), "cell_id", "left_anti")

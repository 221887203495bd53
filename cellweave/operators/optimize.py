"""Mesh optimisation: volumes by moving seeds or weights, interfaces by moving seeds.

Tessellations and derivatives come from the kernel, on the cluster for many seeds and in the
driver's process for up to ``LOCAL`` ones; the Newton and gradient steps are vectors of the number
of seeds, which the driver holds (``MOST`` is checked).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..box import Box
from ..sources import from_arrays
from .clip import WALL, Cells
from .tessellate import build_cells, facets_of, tessellate

LOCAL, MOST = 20_000, 20_000_000


@dataclass
class Result:
    """What an optimiser returns; the values are those of the final positions and weights."""

    positions: np.ndarray
    weights: np.ndarray | None
    iters: int
    max_vol_err: float
    mean_vol_err: float
    n_empty: int
    converged: bool
    energy: float = 0.0
    energy_ratio: float = 1.0


@dataclass
class State:
    """Volumes and facets between seeds: (i, j), area, distance, dV_i/dx_j; own: dV_i/dx_i."""

    volume: np.ndarray
    i: np.ndarray
    j: np.ndarray
    area: np.ndarray
    dist: np.ndarray
    dv: np.ndarray
    own: np.ndarray


class Evaluator:
    def __init__(self, spark, box: Box, sdf=None):
        self.spark, self.box, self.sdf = spark, box, sdf

    def __call__(self, pos: np.ndarray, w: np.ndarray | None) -> State:
        n = len(pos)
        if n > MOST:
            raise ValueError(f"{n} seeds; the driver's vectors are meant for at most {MOST}")
        pos = pos - self.box.edges * np.floor(pos / self.box.edges)
        if n <= LOCAL or self.spark is None:
            c, _, _ = build_cells(pos, np.arange(n), w, np.ones(n, bool), self.box.edges, n, np.inf, 0.0 if w is None else float(w.max()), self.sdf)
            g = c.geometry()
            lane, k = np.nonzero((g["corners"] >= 3) & (c.nt > 0)[:, None])
            nbr, rel, area = c.id[lane, k], c.u[lane, k], g["scalar"][lane, k]
            centre = g["moment"][lane, k] / np.where(area == 0, 1, area)[:, None]
            vector = g["area"][lane, k]
            volume = np.where(c.nt == 0, 0, g["volume"])
        else:
            seeds = from_arrays(self.spark, pos, **({"w": w} if w is not None else {}))
            cells = tessellate(seeds, self.box, weighted=w is not None, sdf=self.sdf, topology=False).cache()
            t = cells.select("cell_id", "volume").toArrow().sort_by("cell_id")
            f = facets_of(cells).toArrow()
            cells.unpersist()
            volume, lane, nbr, area = t["volume"].to_numpy(), f["cell_id"].to_numpy(), f["nbr_id"].to_numpy(), f["area"].to_numpy()
            stack = lambda p: np.stack([f[f"{p}{c}"].to_numpy() for c in "xyz"], 1)
            rel, centre, vector = stack("r"), stack("c"), stack("a")
        own = np.zeros((n, 3))
        wall = nbr == WALL
        if wall.any():
            bend = self.sdf.hessian(pos[lane[wall]])
            np.add.at(own, lane[wall], -vector[wall] + area[wall][:, None] * np.einsum("nij,nj->ni", bend, centre[wall]))
        s = nbr >= 0
        lane, nbr, area, rel, centre = lane[s], nbr[s], area[s], rel[s], centre[s]
        dist = np.sqrt((rel * rel).sum(1))
        dv = (area / dist)[:, None] * (rel - centre)
        for k in range(3):
            own[:, k] -= np.bincount(lane, dv[:, k], n)
        return State(volume, lane, nbr, area, dist, dv, own)


def relative_energy(v: np.ndarray, ref: np.ndarray):
    t = v / ref
    return (t - 1) ** 2, 2 * (t - 1) / ref, 2 / ref**2


def barrier(v: np.ndarray, ref: np.ndarray, mu: float, low: float = 0.1):
    """-mu log(V / ref), continued by its second-order expansion below ``low``."""
    t = v / ref
    far = t > low
    d, safe = t - low, np.where(far, t, 1)
    e = np.where(far, -np.log(safe), -np.log(low) - d / low + d * d / (2 * low * low))
    d1 = np.where(far, -1 / safe, -1 / low + d / low**2) / ref
    d2 = np.where(far, 1 / safe**2, 1 / low**2) / ref**2
    return mu * e, mu * d1, mu * d2


def free_energy(v: np.ndarray, ref: np.ndarray):
    """-ref log V, continued below a tenth of ref."""
    e, d1, d2 = barrier(v, ref, 1.0)
    return ref * (e - np.log(ref)), ref * d1, ref * d2


class Normal:
    """The Gauss-Newton matrix J' diag(curve) J, never formed: J's entries are ``coef`` (m, d) in the
    rows ``cell`` and the blocks of d columns ``node``."""

    def __init__(self, cell: np.ndarray, node: np.ndarray, coef: np.ndarray, curve: np.ndarray, nodes: int):
        self.cell, self.node, self.coef, self.curve, self.nodes = cell, node, coef, curve, nodes

    def forward(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.cell, (self.coef * x[self.node]).sum(1), len(self.curve))

    def back(self, y: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.node, c * y[self.cell], self.nodes) for c in self.coef.T], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.back(self.curve * self.forward(x))

    def diagonal(self) -> np.ndarray:
        return 1e-12 + np.stack([np.bincount(self.node, c * c * self.curve[self.cell], self.nodes) for c in self.coef.T], 1)

    def blocks(self) -> np.ndarray:
        """The d x d blocks on the diagonal; a node met twice by one cell (through two images) counts as two."""
        out = np.zeros((self.nodes, self.coef.shape[1], self.coef.shape[1]))
        for k, c in enumerate(self.coef.T):
            for m, e in enumerate(self.coef.T):
                out[:, k, m] = np.bincount(self.node, c * e * self.curve[self.cell], self.nodes)
        return out + 1e-12 * np.eye(self.coef.shape[1])

    def merged(self) -> "Normal":
        """The same matrix with one entry for each cell and node."""
        pair, at = np.unique(self.cell * self.nodes + self.node, return_inverse=True)
        coef = np.stack([np.bincount(at, c, len(pair)) for c in self.coef.T], 1)
        return Normal(pair // self.nodes, pair % self.nodes, coef, self.curve, self.nodes)


def colours(cell: np.ndarray, node: np.ndarray, cells: int, nodes: int) -> np.ndarray:
    """A number for each node such that no two nodes of a cell share one: one maximal independent set
    after another, nodes of greater rank (a fixed shuffle) first."""
    rank, out, colour = np.random.default_rng(0).permutation(nodes), np.full(nodes, -1), 0
    while (out < 0).any():
        free = out < 0
        while free.any():
            own = np.where(free, rank, -1)
            top = np.full(cells, -1)
            np.maximum.at(top, cell, own[node])
            pick = free.copy()
            pick[node[top[cell] != own[node]]] = False
            out[pick] = colour
            met = np.zeros(cells, bool)
            met[cell[pick[node]]] = True
            free &= ~pick
            free[node[met[cell]]] = False
        colour += 1
    return out


def coloured_sweeps(h: Normal):
    """Symmetric Gauss-Seidel: nodes of a colour share no cell, so they are relaxed together; sweeps
    go up the colours and down again, with J x kept up to date."""
    h = h.merged()
    number = colours(h.cell, h.node, len(h.curve), h.nodes)
    solve, order = np.linalg.inv(h.blocks()), np.argsort(number[h.node], kind="stable")
    cuts = np.searchsorted(number[h.node][order], np.arange(number.max(initial=-1) + 2))
    parts = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        at = order[lo:hi]
        nodes, local = np.unique(h.node[at], return_inverse=True)
        parts.append((nodes, Normal(h.cell[at], local, h.coef[at], h.curve, len(nodes))))

    def run(r: np.ndarray) -> np.ndarray:
        x, y = np.zeros_like(r), np.zeros(len(h.curve))
        for nodes, j in parts + parts[::-1]:
            step = np.einsum("nij,nj->ni", solve[nodes], r[nodes] - j.back(h.curve * y))
            x[nodes] += step
            np.add.at(y, j.cell, (j.coef * step[j.node]).sum(1))
        return x

    return run


def aggregates(h: Normal) -> np.ndarray:
    """The aggregate of each node: a colour's nodes are roots, and the others go with the first root
    that shares a cell with them."""
    roots = np.flatnonzero(colours(h.cell, h.node, len(h.curve), h.nodes) == 0)
    out = np.full(h.nodes, len(roots))
    out[roots] = np.arange(len(roots))
    near = np.full(len(h.curve), len(roots))
    np.minimum.at(near, h.cell, out[h.node])
    found = np.full(h.nodes, len(roots))
    np.minimum.at(found, h.node, near[h.cell])
    out = np.where(out < len(roots), out, found)
    return np.unique(out, return_inverse=True)[1]


def graph_cycle(h: Normal, coarsest: int = 60):
    """A V-cycle over aggregates of the graph: damped Jacobi, the correction by constants on
    aggregates, damped Jacobi; the coarsest level is solved densely."""
    size = np.sqrt(h.diagonal().mean(0))  # positions and weights differ in their units
    scaled = _cycle(Normal(h.cell, h.node, h.coef / size, h.curve, h.nodes).merged(), coarsest)
    return lambda r: scaled(r / size) / size


def _cycle(h: Normal, coarsest: int):
    d = h.coef.shape[1]
    if h.nodes <= coarsest:
        full = np.stack([h(e.reshape(h.nodes, d)).ravel() for e in np.eye(h.nodes * d)], 1)
        solve = np.linalg.pinv((full + full.T) / 2 + 1e-12 * np.eye(len(full)) * np.trace(full) / len(full), rcond=1e-13, hermitian=True)
        return lambda r: (solve @ r.ravel()).reshape(r.shape)
    group, diagonal = aggregates(h), h.diagonal()
    count = int(group.max()) + 1
    if count >= h.nodes:
        return lambda r: r / diagonal
    below = _cycle(Normal(h.cell, group[h.node], h.coef, h.curve, count).merged(), coarsest)
    v, top = np.random.default_rng(0).random((h.nodes, d)), 1.0
    for _ in range(20):  # the greatest eigenvalue of the scaled matrix, from below
        v = h(v) / diagonal
        top = float(np.abs(v).max())
        v /= top
    damp = 1.0 / (1.1 * top) / diagonal

    def run(r: np.ndarray) -> np.ndarray:
        x = damp * r
        left = r - h(x)
        x = x + below(np.stack([np.bincount(group, c, count) for c in left.T], 1))[group]
        return x + damp * (r - h(x))

    return run


def _jacobian(s: State, d2: np.ndarray, weights: tuple[np.ndarray, np.ndarray] | None = None) -> Normal:
    """By positions and, with ``weights`` (of neighbours, of cells), by weights."""
    n = len(s.volume)
    own, dv = s.own, s.dv
    if weights is not None:
        own, dv = np.column_stack((own, weights[1])), np.column_stack((dv, -weights[0]))
    return Normal(np.concatenate((np.arange(n), s.i)), np.concatenate((np.arange(n), s.j)), np.concatenate((own, dv)), d2, n)


def _cg(apply, b: np.ndarray, precondition, iters: int, tol: float = 1e-10) -> np.ndarray:
    """Conjugate gradients; ``precondition`` maps a residual to a step."""
    x, r = np.zeros_like(b), b.copy()
    z = precondition(r)
    p, rz = z.copy(), float((r * z).sum())
    stop = tol**2 * float((b * b).sum())
    for _ in range(iters):
        ap = apply(p)
        curve = float((p * ap).sum())
        if curve <= 0:
            break
        step = rz / curve
        x, r = x + step * p, r - step * ap
        if float((r * r).sum()) <= stop:
            break
        z = precondition(r)
        rz, old = float((r * z).sum()), rz
        p = z + rz / old * p
    return x


METHODS = ("jacobi", "steepest", "graphamg", "colored_gs")


def optimize_volume_mesh(positions: np.ndarray, vset: np.ndarray, box: Box | float = 1.0, max_newton: int = 60, tol: float = 1e-9, cg_iters: int = 300,
                         use_weights: bool = False, method: str = "jacobi", mu_barrier: float = 0.0, barrier_decay: float = 0.7, use_free_energy: bool = False,
                         sdf=None, spark=None) -> Result:
    """Moves seeds (and weights) so that volumes approach ``vset``: minimises the sum of
    (V / vset - 1)^2 by Gauss-Newton steps, solved by conjugate gradients, with Armijo line search;
    stops when no component of the gradient exceeds ``tol``.

    ``mu_barrier`` adds a decaying logarithmic barrier against collapse; ``use_free_energy`` minimises
    -vset log V instead.  ``method``: the step's preconditioner (jacobi, colored_gs: ``coloured_sweeps``,
    graphamg: ``graph_cycle``) or steepest descent; any other name is an error.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    box = Box.of(box)
    run = Evaluator(spark, box, sdf)
    x, n = np.array(positions, float), len(positions)
    ref = np.asarray(vset, float)
    w = np.zeros(n) if use_weights else None
    mu, s = mu_barrier, run(x, w)

    def cost(v, mu):
        e, d1, d2 = free_energy(v, ref) if use_free_energy else relative_energy(v, ref)
        if mu > 0:
            e, d1, d2 = (a + b for a, b in zip((e, d1, d2), barrier(v, ref, mu)))
        return float(e.sum()), d1, d2

    def weight_terms(s):
        a = s.area / (2 * s.dist)
        return a, np.bincount(s.i, a, n)

    it, converged = 0, False
    for it in range(max_newton + 1):
        e, d1, d2 = cost(s.volume, mu)
        h = _jacobian(s, d2, weight_terms(s) if use_weights else None)
        g = h.back(d1)
        if np.abs(g).max(initial=0) < tol:
            converged = True
            break
        if it == max_newton:
            break
        if method == "steepest":
            both = -g
        else:
            diagonal = h.diagonal()
            solve = coloured_sweeps(h) if method == "colored_gs" else graph_cycle(h) if method == "graphamg" else lambda r: r / diagonal
            both = _cg(lambda p: h(p) + 1e-10 * diagonal * p, -g, solve, cg_iters)
        step, step_w = both[:, :3], both[:, 3] if use_weights else None
        slope = float((g * both).sum())
        longest = np.sqrt((step**2).sum(1)).max(initial=0)
        t = min(1.0, 0.25 * box.spacing(n) / longest) if longest > 0 else 1.0
        for _ in range(24):
            nx = x + t * step
            nw = w + t * step_w if use_weights else None
            s2 = run(nx, nw)
            if cost(s2.volume, mu)[0] <= e + 1e-4 * t * slope:
                x, w, s = nx, nw, s2
                break
            t /= 2
        else:
            break
        mu *= barrier_decay
    err = np.abs(s.volume - ref)
    x = x - box.edges * np.floor(x / box.edges)
    return Result(x, w, it, float(err.max(initial=0)), float(err.mean()) if n else 0.0, int((s.volume <= 0).sum()), converged, cost(s.volume, 0)[0])


def optimize_pore_mesh(positions, vref, sphere_centres, sphere_radii, box: Box | float = 1.0, max_iter: int = 80, tol: float = 1e-9, cg_iters: int = 400,
                       method: str = "graphamg", mu_barrier: float = 0.0, use_free_energy: bool = False, spark=None) -> Result:
    """``optimize_volume_mesh`` in the pores of a periodic packing of solid spheres."""
    from .walls import PeriodicSpheres

    box = Box.of(box)
    solid = PeriodicSpheres(tuple(map(tuple, np.asarray(sphere_centres, float).tolist())), tuple(np.asarray(sphere_radii, float).tolist()), box)
    return optimize_volume_mesh(positions, np.broadcast_to(np.asarray(vref, float), len(positions)), box, max_iter, tol, cg_iters, method=method, mu_barrier=mu_barrier, use_free_energy=use_free_energy, sdf=solid, spark=spark)


def optimal_transport_weights(positions: np.ndarray, vset: np.ndarray, box: Box | float = 1.0, max_newton: int = 40, tol: float = 1e-9, damping: float = 1.0, sdf=None, spark=None) -> Result:
    """Weights at fixed positions whose power cells have the volumes ``vset`` (scaled to fill the box):
    damped Newton steps on the facet Laplacian, area over twice the distance, first weight pinned; a
    step is halved until no more cells are empty and the residual falls.  A cell whose seed would lie
    outside of it can't be represented, so strongly graded targets on irregular seeds may end early
    (``converged`` is then false)."""
    box = Box.of(box)
    run, x, n = Evaluator(spark, box, sdf), np.asarray(positions, float), len(positions)
    goal, w = np.asarray(vset, float), np.zeros(len(positions))
    s = run(x, w)
    goal = goal * (s.volume.sum() / goal.sum())
    it, converged = 0, False
    for it in range(max_newton + 1):
        r = goal - s.volume
        if np.abs(r).max() < tol:
            converged = True
            break
        if it == max_newton:
            break
        a = s.area / (2 * s.dist)
        diag = np.bincount(s.i, a, n)

        def apply(p):
            p = np.concatenate(([0.0], p[1:]))
            out = diag * p - np.bincount(s.i, a * p[s.j], n)
            out[0] = 0
            return out

        b = r.copy()
        b[0] = 0
        step, t, before = _cg(apply, b, lambda r: r / np.maximum(diag, 1e-30), 20 * int(n**0.5) + 200), damping, float(np.sqrt((r * r).sum()))
        for _ in range(30):
            s2 = run(x, w + t * step)
            r2 = goal - s2.volume
            if (s2.volume > 0).sum() >= (s.volume > 0).sum() and np.sqrt((r2 * r2).sum()) < before:
                break
            t /= 2
        else:
            break
        w, s = w + t * step, s2
    err = np.abs(goal - s.volume)
    return Result(x, w, it, float(err.max()), float(err.mean()), int((s.volume <= 0).sum()), converged)


def laplacian(facets: DataFrame) -> DataFrame:
    """``i, j, weight``: the edges of the transport Laplacian, area / (2 distance)."""
    d = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz"))
    return facets.where((F.col("nbr_id") >= 0) & (F.col("area") > 0)).select(F.col("cell_id").alias("i"), F.col("nbr_id").alias("j"), (F.col("area") / (2 * d)).alias("weight"))


def interface_terms(c: Cells, ids: np.ndarray, types_of) -> tuple[np.ndarray, np.ndarray, float]:
    """(seed ids, gradient rows, half the area between types) of cells' facets.

    A face's area changes by the motion of its rim: along an edge with plane l, at the edge's middle,
    plane l's normal motion less cos(angle) times the face's own, over sin(angle)."""
    g = c.geometry()
    norm = np.sqrt((c.u**2).sum(2))
    norm[norm == 0] = 1
    unit = c.u / norm[:, :, None]
    cl = np.repeat(np.arange(c.n), c.nt)
    sl = np.arange(len(cl)) - np.repeat(np.cumsum(c.nt) - c.nt, c.nt)
    t, v = c.tri[cl, sl], c.v[cl, sl]
    lane, a, b = np.repeat(cl, 3), t.reshape(-1), t[:, [1, 2, 0]].reshape(-1)
    ends = np.repeat(v, 3, axis=0)
    planes = c.u.shape[1]
    forward, backward = (lane * planes + a) * planes + b, (lane * planes + b) * planes + a
    order = np.argsort(forward)
    at = np.minimum(np.searchsorted(forward[order], backward), max(len(order) - 1, 0))
    mate = order[at]
    ok = forward[mate] == backward
    length = np.where(ok, np.sqrt(((ends - ends[mate]) ** 2).sum(1)), 0)
    middle = (ends + ends[mate]) / 2
    own, nbr = types_of(ids)[lane], c.id[lane, a]
    face = ok & (nbr >= 0)
    face[face] = types_of(nbr[face]) != own[face]
    lane, a, b, length, middle, nbr = lane[face], a[face], b[face], length[face], middle[face], nbr[face]
    cos = np.clip((unit[lane, a] * unit[lane, b]).sum(1), -1, 1)
    sin = np.sqrt(np.maximum(1 - cos * cos, 1e-12))
    rows, grads = [], []
    for plane, factor in ((b, length / sin), (a, -length * cos / sin)):
        j = c.id[lane, plane]
        seed = j >= 0
        push = 0.5 * (factor / norm[lane, plane])[:, None] * (c.u[lane, plane] - middle)
        rows += [j[seed], ids[lane[seed]]]
        grads += [push[seed], -push[seed]]
    k = np.nonzero((g["corners"] >= 3) & (c.id >= 0))
    other = types_of(c.id[k]) != types_of(ids)[k[0]]
    return np.concatenate(rows), np.concatenate(grads), 0.5 * float(g["scalar"][k][other].sum())


def interface_gradient(positions: np.ndarray, types: np.ndarray, box: Box, spark=None) -> tuple[float, np.ndarray]:
    """Area between cells of different type and its derivative by positions."""
    n, types = len(positions), np.asarray(types)
    if n <= LOCAL or spark is None:
        c, _, _ = build_cells(positions, np.arange(n), None, np.ones(n, bool), box.edges, n, np.inf)
        rows, grads, area = interface_terms(c, np.arange(n), lambda i: types[i])
        return area, np.stack([np.bincount(rows, grads[:, k], n) for k in range(3)], 1)
    from .moving import unpacked

    edges = box.edges
    cells = tessellate(from_arrays(spark, positions), box)

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            rows, grads, area = interface_terms(unpacked(t, edges), t["cell_id"].to_numpy(), lambda i: types[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(rows, -1)), *[pa.array(np.append(grads[:, k], area)) for k in range(3)]], names=["i", "gx", "gy", "gz"])

    t = cells.mapInArrow(run, "i long, gx double, gy double, gz double").groupBy("i").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in "xyz"]).toArrow()
    i, out, area = t["i"].to_numpy(), np.zeros((n, 3)), 0.0
    for k, c in enumerate("xyz"):
        v = t[f"g{c}"].to_numpy()
        out[i[i >= 0], k] = v[i >= 0]
        area = float(v[i < 0][0])
    return area, out


def minimize_interface(positions: np.ndarray, types: np.ndarray, sigma: float = 1.0, box: Box | float = 1.0, max_iter: int = 60, tol: float = 1e-9, spark=None) -> Result:
    """Moves seeds down the gradient of sigma times the interface area, no step longer than 2 % of the
    mean spacing, until the gradient is below ``tol`` or the energy no longer falls."""
    box = Box.of(box)
    x = np.array(positions, float)
    area, g = interface_gradient(x, types, box, spark)
    first, trust, it, converged = area, 0.02 * box.spacing(len(x)), 0, False
    for it in range(max_iter + 1):
        longest = float(np.sqrt((g * g).sum(1)).max(initial=0))
        if sigma * longest < tol:
            converged = True
            break
        if it == max_iter:
            break
        t = trust / longest
        for _ in range(20):
            y = x - t * g
            y = y - box.edges * np.floor(y / box.edges)
            area2, g2 = interface_gradient(y, types, box, spark)
            if area2 < area:
                break
            t /= 2
        else:
            break
        x, area, g = y, area2, g2
    return Result(x, None, it, 0.0, 0.0, 0, converged, sigma * area, area / first if first else 1.0)

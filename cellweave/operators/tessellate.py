"""Voronoi and power tessellations: blocks with halos, one clip kernel, tables out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..box import Box
from ..plans import staged
from ..plans.blocks import Blocks
from .clip import EMPTY, INCOMPLETE, OK, Cells, clip_against_solid, min_image

FACETS = "array<struct<nbr_id:bigint,ax:double,ay:double,az:double,cx:double,cy:double,cz:double,rx:double,ry:double,rz:double,vx:double,vy:double,vz:double,area:double>>"
PLANES = "array<struct<nbr_id:bigint,nx:double,ny:double,nz:double,off:double>>"
CORNERS = "array<struct<a:int,b:int,c:int,x:double,y:double,z:double>>"
CELLS = f"cell_id long, x double, y double, z double, w double, status int, volume double, n_facets int, n_neighbors int, r2_max double, facets {FACETS}, planes {PLANES}, corners {CORNERS}"

#: Seeds in a bin of the kernel's own grid, bins looked at each way, nearest seeds taken at first.
BIN_SEEDS, BIN_REACH, FIRST = 4, 2, 112


def _order(d2: np.ndarray, limit: int) -> np.ndarray:
    """Per row, the ``limit`` nearest columns, closest first, ties by column (columns ascend by id)."""
    if d2.shape[1] > limit:
        part = np.argpartition(d2, limit - 1, 1)[:, :limit]
        part.sort(1)
    else:
        part = np.broadcast_to(np.arange(d2.shape[1]), d2.shape)
    near = np.take_along_axis(d2, part, 1)
    order = np.argsort(near, 1, kind="stable")
    return np.take_along_axis(part, order, 1)


def clip_by_neighbours(cells: Cells, lanes, rel, ids, weight_self, weight_nbr, w_max: float, weighted: bool) -> np.ndarray:
    """Clips lanes by neighbours in the order given until none further can cut; rel is [lane,
    neighbour, 3], inf for none.  Returns the squared distance up to which each lane was served."""
    d2 = np.where(np.isfinite(rel[:, :, 0]), (rel * rel).sum(2), np.inf)
    served = np.full(len(lanes), np.inf)
    if weighted:
        buried = (d2 + weight_self[:, None] <= weight_nbr).any(1)
        cells.empty(lanes[buried])
        served[buried] = 0
        gap = np.maximum(w_max - weight_self, 0)
    live = np.flatnonzero(cells.nt[lanes] > 0)
    for k in range(rel.shape[1]):
        r2 = cells.r2[lanes[live]]
        reach = (np.sqrt(r2) + np.sqrt(r2 + gap[live])) ** 2 if weighted else 4 * r2
        go = (d2[live, k] <= reach) & np.isfinite(d2[live, k])
        live = live[go]
        if not len(live):
            break
        off = d2[live, k] / 2
        if weighted:
            off = off + (weight_self[live] - weight_nbr[live, k]) / 2
        cells.clip(lanes[live], rel[live, k], off, ids[live, k])
        live = live[cells.nt[lanes[live]] > 0]
    return np.where(np.isinf(d2[:, -1]), np.inf, d2[:, -1]) if rel.shape[1] else np.full(len(lanes), np.inf)


def build_cells(pos: np.ndarray, ids: np.ndarray, weights: np.ndarray | None, owned: np.ndarray, box: np.ndarray, n_total: int,
                halo: float, w_max: float = 0.0, sdf=None) -> tuple[Cells, np.ndarray, np.ndarray]:
    """The cells of the owned seeds among all that are given: (cells, status, which are empty).

    ``halo`` is the distance round each owned seed within which all seeds are given."""
    weighted = weights is not None
    if (ids[1:] < ids[:-1]).any():
        raise ValueError("ids must ascend")
    mine = np.flatnonzero(owned)
    cells = Cells(len(mine), box)
    served = np.zeros(len(mine))
    edge = (BIN_SEEDS * box.prod() / max(n_total, 1)) ** (1 / 3)
    dims = np.maximum(1, (box / edge).astype(int))
    binned = (np.floor(pos * (dims / box)).astype(int)) % dims
    code = binned[:, 0] + dims[0] * (binned[:, 1] + dims[1] * binned[:, 2])
    order = np.lexsort((ids, code))
    sorted_code = code[order]
    wide = (dims < 2 * BIN_REACH + 1).any() or len(pos) < 600

    def run(lanes: np.ndarray, cand: np.ndarray, limit: int) -> None:
        """Lanes (of mine) against candidates (rows of pos), in chunks."""
        for lo in range(0, len(lanes), max(1, 400_000 // max(1, len(cand)))):
            some = lanes[lo : lo + max(1, 400_000 // max(1, len(cand)))]
            rel = min_image(pos[cand][None] - pos[mine[some]][:, None], box)
            d2 = (rel * rel).sum(2)
            same = ids[cand][None] == ids[mine[some]][:, None]
            d2[same] = np.inf
            at = _order(d2, limit)
            got = np.take_along_axis(d2, at, 1)
            queue.append((some, np.where(np.isfinite(got)[:, :, None], np.take_along_axis(rel, at[:, :, None], 1), np.inf), ids[cand][at], weights[cand][at] if weighted else None, len(cand) <= limit))

    def drain(reach: float) -> None:
        """Clips what is queued, all lanes together, and notes how far each has been served."""
        while queue:
            parts = [queue.pop() for _ in range(min(len(queue), 600))]
            width = max(p[1].shape[1] for p in parts)
            pad = lambda a, v: np.pad(a, ((0, 0), (0, width - a.shape[1])) + ((0, 0),) * (a.ndim - 2), constant_values=v)
            lanes = np.concatenate([p[0] for p in parts])
            rel, nbr = np.concatenate([pad(p[1], np.inf) for p in parts]), np.concatenate([pad(p[2], -1) for p in parts])
            wn = np.concatenate([pad(p[3], -np.inf) for p in parts]) if weighted else None
            last = clip_by_neighbours(cells, lanes, rel, nbr, weights[mine[lanes]] if weighted else None, wn, w_max, weighted)
            served[lanes] = np.minimum(last, reach * reach)

    def wanting() -> np.ndarray:
        r2 = cells.r2
        need = (np.sqrt(r2) + np.sqrt(r2 + np.maximum(w_max - weights[mine], 0))) ** 2 if weighted else 4 * r2
        return np.flatnonzero((cells.nt > 0) & (need > served))

    queue: list = []
    if wide:
        run(np.arange(len(mine)), np.arange(len(pos)), FIRST)
        drain(halo)
    else:
        homes, first = np.unique(code[mine], return_index=True)
        by_home = np.argsort(code[mine], kind="stable")
        cuts = np.searchsorted(code[mine][by_home], homes)
        steps = np.array(np.meshgrid(*[np.arange(-BIN_REACH, BIN_REACH + 1)] * 3, indexing="ij")).reshape(3, -1).T
        for h, lo, hi in zip(homes, cuts, np.append(cuts[1:], len(mine))):
            at = (np.array([h % dims[0], h // dims[0] % dims[1], h // (dims[0] * dims[1])]) + steps) % dims
            codes = at[:, 0] + dims[0] * (at[:, 1] + dims[1] * at[:, 2])
            a, b = np.searchsorted(sorted_code, codes), np.searchsorted(sorted_code, codes, "right")
            cand = np.sort(np.concatenate([order[i:j] for i, j in zip(a, b) if j > i]))
            run(by_home[lo:hi], cand, FIRST)
        drain(min(halo, BIN_REACH * float((box / dims).min())))
    more = wanting()
    limit = 4 * FIRST
    while len(more) and not (wide and limit > 4 * len(pos)):
        # the few that reach further start again, against all that is here
        cells.reset(more)
        run(more, np.arange(len(pos)), limit)
        drain(halo)
        if limit >= len(pos):
            break
        more, limit = wanting(), 4 * limit
    if not np.isfinite(halo):
        further_images(cells, pos, ids, weights, mine, box, w_max)
    empty = cells.nt == 0
    status = np.where(empty, EMPTY, OK)
    if np.isfinite(halo):
        status[wanting()] = INCOMPLETE
    if sdf is not None:
        clip_against_solid(cells, pos[mine], sdf)
        status[(cells.nt == 0)] = EMPTY
    return cells, status, mine


def further_images(cells: Cells, pos, ids, weights, mine, box: np.ndarray, w_max: float) -> None:
    """Clips cells that reach beyond a quarter of an edge by the seeds' images next to the nearest.

    A place in such a cell lies within half an edge of its seed along each axis, so the image of a
    neighbour nearest to it lies within an edge: along each axis the nearest to the seed, or the one
    on the other side."""
    weighted = weights is not None

    def need() -> np.ndarray:
        return (np.sqrt(cells.r2) + np.sqrt(cells.r2 + np.maximum(w_max - weights[mine], 0))) ** 2 if weighted else 4 * cells.r2

    lanes = np.flatnonzero((cells.nt > 0) & (need() > (box.min() / 2) ** 2))
    step = max(1, 100_000 // max(1, len(pos)))
    sides = np.array(np.meshgrid(*[[0, 1]] * 3, indexing="ij")).reshape(3, -1).T[1:]
    for lo in range(0, len(lanes), step):
        some = lanes[lo : lo + step]
        rel = min_image(pos[None] - pos[mine[some]][:, None], box)
        rel = np.concatenate([rel - side * np.where(rel < 0, -box, box) for side in sides], 1)
        d2 = (rel * rel).sum(2)
        nbr = np.broadcast_to(np.tile(np.arange(len(pos)), len(sides)), d2.shape)
        d2[ids[nbr] == ids[mine[some]][:, None]] = np.inf
        reached = d2 <= need()[some][:, None]
        at = _order(np.where(reached, d2, np.inf), int(max(1, reached.sum(1).max())))
        got = np.take_along_axis(reached, at, 1)
        rel = np.where(got[:, :, None], np.take_along_axis(rel, at[:, :, None], 1), np.inf)
        nbr = np.take_along_axis(nbr, at, 1)
        clip_by_neighbours(cells, some, rel, ids[nbr], weights[mine[some]] if weighted else None, np.where(got, weights[nbr], -np.inf) if weighted else None, w_max, weighted)


def _list(counts: np.ndarray, fields: dict[str, np.ndarray]) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields)))


def as_table(cells: Cells, status: np.ndarray, pos: np.ndarray, ids: np.ndarray, weights: np.ndarray | None, topology: bool) -> pa.Table:
    """Rows of ``CELLS``; with ``topology`` also planes and corners."""
    g = cells.geometry()
    empty = cells.nt == 0
    volume = np.where(empty, 0.0, g["volume"])
    is_face = (g["corners"] >= 3) & ~empty[:, None]
    lane, k = np.nonzero(is_face)
    area, scalar = g["area"][lane, k], g["scalar"][lane, k]
    centre = g["moment"][lane, k] / np.where(scalar == 0, 1, scalar)[:, None]
    nbr, u, h = cells.id[lane, k], cells.u[lane, k], cells.h[lane, k]
    # between seeds the normal is the vector to the neighbour; a box or wall plane's image is its mirror
    rel = np.where((nbr >= 0)[:, None], u, u * (2 * h / (u * u).sum(1))[:, None])
    length = np.sqrt((rel * rel).sum(1))
    dv = (scalar / length)[:, None] * (rel - centre)
    facets = _list(is_face.sum(1), {"nbr_id": nbr, **{f"a{c}": area[:, i] for i, c in enumerate("xyz")}, **{f"c{c}": centre[:, i] for i, c in enumerate("xyz")},
                                    **{f"r{c}": rel[:, i] for i, c in enumerate("xyz")}, **{f"v{c}": dv[:, i] for i, c in enumerate("xyz")}, "area": scalar})
    n = len(status)
    if topology:
        pl, pk = np.nonzero((np.arange(cells.u.shape[1]) < cells.count[:, None]) & ~empty[:, None])
        planes = _list(np.where(empty, 0, cells.count), {"nbr_id": cells.id[pl, pk], **{f"n{c}": cells.u[pl, pk, i] for i, c in enumerate("xyz")}, "off": cells.h[pl, pk]})
        cl = np.repeat(np.arange(n), cells.nt)
        cs = np.arange(len(cl)) - np.repeat(np.cumsum(cells.nt) - cells.nt, cells.nt)
        corners = _list(cells.nt, {**{c: cells.tri[cl, cs, i] for i, c in enumerate("abc")}, **{c: cells.v[cl, cs, i] for i, c in enumerate("xyz")}})
    else:
        planes, corners = pa.nulls(n, _arrow_type(PLANES)), pa.nulls(n, _arrow_type(CORNERS))
    return pa.table({
        "cell_id": ids, "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2], "w": weights if weights is not None else np.zeros(n), "status": status.astype(np.int32), "volume": volume,
        "n_facets": is_face.sum(1).astype(np.int32), "n_neighbors": ((g["corners"] >= 1) & ~empty[:, None]).sum(1).astype(np.int32), "r2_max": cells.r2, "facets": facets, "planes": planes, "corners": corners,
    })


def _arrow_type(ddl: str) -> pa.DataType:
    inner = ddl[len("array<struct<") : -2]
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    return pa.list_(pa.struct([(n, kinds[k]) for n, k in (f.split(":") for f in inner.split(","))]))


def tessellate(seeds: DataFrame, box: Box | float = 1.0, weighted: bool = False, sdf=None, only: DataFrame | None = None, topology: bool = True,
               block_seeds: int = 2_000, halo: float = 4.5) -> DataFrame:
    """The cells of ``seeds(cell_id, x, y, z[, w])`` in a periodic box, a row each, schema ``CELLS``.

    Positions are in [0, edge).  Seeds go to the blocks near them in one shuffle; each block clips
    its own cells.  Blocks hold about ``block_seeds`` seeds each however they lie.  A cell that
    reaches beyond the ``halo`` (in its block's own spacings) is built again with four times that,
    until all are complete.  ``only``: a table of ``cell_id`` whose cells alone are
    built, from the seeds near the blocks that own them.  With ``weighted``, ``w`` shifts planes as in power diagrams; a seed whose centre a
    neighbour's weight covers is empty.  With ``sdf``, cells are clipped at the solid.

    Null coordinates, weights or ids take no part.  An empty table gives no rows.
    """
    box = Box.of(box)
    w = F.col("w").cast("double") if weighted else F.lit(0.0)
    rows = seeds.select(F.col("cell_id").cast("long").alias("cell_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], w.alias("w")).dropna()
    n, w_max = rows.agg(F.count("*"), F.max("w")).first()
    w_max = float(w_max or 0)
    blocks = Blocks.fitted(rows, box, n, block_seeds, seeds.sparkSession.sparkContext.defaultParallelism)
    edges = box.edges

    def built(which: DataFrame, reach: np.ndarray) -> DataFrame:
        def kernel(t: pa.Table) -> pa.Table:
            t = t.sort_by("cell_id")  # a cell doesn't depend on the block or the order of arrival
            own = t["is_owned"].to_numpy() & t["wanted"].to_numpy()
            pos = np.stack([t[c].to_numpy() for c in "xyz"], 1)
            ids, wt = t["cell_id"].to_numpy(), t["w"].to_numpy() if weighted else None
            block = t["block"][0].as_py()
            like = max(1, round(box.volume / blocks.spacing[block] ** 3))  # seeds in the box if all of it were as dense
            cells, status, mine = build_cells(pos, ids, wt, own, edges, like, float(reach[block]), w_max, sdf)
            return as_table(cells, status, pos[mine], ids[mine], wt[mine] if weighted else None, topology)

        return blocks.replicated(which, reach).groupBy("block").applyInArrow(kernel, CELLS)

    def wanted_rows(some: DataFrame) -> DataFrame:
        some = some.select("cell_id", F.lit(True).alias("wanted"))
        return rows.join(some, "cell_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))

    def asked(reach: np.ndarray, some: DataFrame) -> np.ndarray:
        """Seeds go only to blocks that own a wanted cell, to all of the box from half an edge on."""
        reach = np.where(2 * reach >= min(edges), np.inf, reach)
        return np.where(np.isin(np.arange(len(blocks)), blocks.owners(some)), reach, -1.0)

    reach = halo * blocks.spacing + (w_max**0.5 if weighted and w_max > 0 else 0)
    if only is not None:
        which = wanted_rows(only)
        now = asked(reach, which.where("wanted"))
    else:
        which, now = rows.withColumn("wanted", F.lit(True)), np.where(2 * reach >= min(edges), np.inf, reach)
    if np.isinf(now[now >= 0]).all():
        return built(which, now)
    parts = []
    while True:
        out = staged(built(which, now), "cells")
        parts.append(out.where(F.col("status") != INCOMPLETE))
        left = out.where(F.col("status") == INCOMPLETE)
        if left.isEmpty():
            break
        reach = 4 * reach
        which, now = wanted_rows(left), asked(reach, left)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def facets_of(cells: DataFrame) -> DataFrame:
    """A row per facet: neighbour, area vector, centroid, vector to the neighbour, the derivative
    (vx, vy, vz) of the cell's volume by the neighbour's position, and the scalar area."""
    return cells.select("cell_id", F.inline("facets"))


def corners_of(cells: DataFrame) -> DataFrame:
    """A row per vertex: its three planes and its place relative to the seed."""
    return cells.select("cell_id", F.posexplode("corners").alias("corner", "q")).select("cell_id", "corner", "q.*")


def planes_of(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id", F.posexplode("planes").alias("k", "p")).select("cell_id", "k", "p.*")

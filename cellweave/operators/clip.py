"""The convex clip kernel: many cells at once, a lane each.

A cell is a set of planes ``u . v <= h`` (a normal of any length, seed at the origin) and its
vertices, each on three planes.  Clipping by one more plane removes the vertices strictly outside it and joins
the rim of the hole to the new plane; a plane that only touches the cell changes nothing.  All lanes
are clipped together, each by its own next plane.
"""

from __future__ import annotations

import numpy as np

#: What a cell's status may hold: complete, reaching beyond the seeds it has seen, without volume.
OK, INCOMPLETE, EMPTY = 0, 1, 2
#: Neighbour ids of what is no seed.
BOX, WALL = -1, -2


class Cells:
    def __init__(self, n: int, box: np.ndarray, planes: int = 28, corners: int = 44):
        self.n = n
        self.u = np.zeros((n, planes, 3))
        self.h = np.zeros((n, planes))
        self.id = np.full((n, planes), BOX, np.int64)
        self.tri = np.zeros((n, corners, 3), np.int32)
        self.v = np.zeros((n, corners, 3))
        self.count, self.nt, self.r2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        self.half = np.asarray(box, float) / 2
        self.reset(np.arange(n))

    def reset(self, lanes: np.ndarray) -> None:
        """The whole box again."""
        self.id[lanes], self.count[lanes], self.nt[lanes] = BOX, 6, 8
        for k in range(3):
            self.u[lanes, 2 * k : 2 * k + 2] = 0
            self.u[lanes, 2 * k, k], self.u[lanes, 2 * k + 1, k] = -1, 1
            self.h[lanes, 2 * k], self.h[lanes, 2 * k + 1] = self.half[k], self.half[k]
        for t in range(8):
            sign = np.array([t & 1, t >> 1 & 1, t >> 2 & 1])
            order = [0, 1, 2] if sign.sum() % 2 else [0, 2, 1]  # outward orientation
            self.tri[lanes, t] = [2 * k + sign[k] for k in order]
            self.v[lanes, t] = (2 * sign - 1) * self.half
        self.r2[lanes] = (self.half**2).sum()

    def _room(self, planes: int, corners: int) -> None:
        if planes > self.u.shape[1]:
            more = planes + 8 - self.u.shape[1]
            self.u = np.pad(self.u, ((0, 0), (0, more), (0, 0)))
            self.h = np.pad(self.h, ((0, 0), (0, more)))
            self.id = np.pad(self.id, ((0, 0), (0, more)), constant_values=BOX)
        if corners > self.v.shape[1]:
            more = corners + 16 - self.v.shape[1]
            self.tri = np.pad(self.tri, ((0, 0), (0, more), (0, 0)))
            self.v = np.pad(self.v, ((0, 0), (0, more), (0, 0)))

    def empty(self, lanes: np.ndarray) -> None:
        self.nt[lanes] = 0
        self.r2[lanes] = 0

    def clip(self, lanes: np.ndarray, u: np.ndarray, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Clips each lane (each at most once in a call) by its plane; which lanes changed."""
        top = int(self.nt[lanes].max(initial=0))
        if not top:
            return np.zeros(len(lanes), bool)
        there = np.arange(top) < self.nt[lanes][:, None]
        out = (np.matmul(self.v[lanes, :top], u[:, :, None])[:, :, 0] - h[:, None] > 0) & there
        hit = out.any(1)
        if not hit.any():
            return hit
        gone = hit & (out | ~there).all(1)
        self.empty(lanes[gone])
        cut = np.flatnonzero(hit & ~gone)
        if len(cut):
            self._cut(lanes[cut], out[cut], u[cut], h[cut], ids[cut])
        return hit

    def _cut(self, lanes, out, u, h, ids) -> None:
        self._room(int(self.count[lanes].max()) + 1, int(self.nt[lanes].max()) + 2)
        new = self.count[lanes]
        self.u[lanes, new], self.h[lanes, new], self.id[lanes, new] = u, h, ids
        self.count[lanes] += 1
        row, slot = np.nonzero(out)
        t = self.tri[lanes[row], slot]
        er, a, b = np.repeat(row, 3), t.reshape(-1), t[:, [1, 2, 0]].reshape(-1)
        planes = self.u.shape[1]
        inside = np.zeros((len(lanes), planes, planes), bool)
        inside[er, a, b] = True
        rim = ~inside[er, b, a]
        er, a, b = er[rim], a[rim], b[rim]
        lost, made = np.bincount(row, minlength=len(lanes)), np.bincount(er, minlength=len(lanes))
        nth = np.arange(len(er)) - np.repeat(np.cumsum(made) - made, made)
        first_lost = np.cumsum(lost) - lost
        # new corners take the places of lost ones, then new places
        at = np.where(nth < lost[er], slot[np.minimum(first_lost[er] + nth, len(slot) - 1)], self.nt[lanes[er]] + nth - lost[er])
        if int(at.max(initial=0)) >= self.v.shape[1]:
            self._room(0, int(at.max()) + 1)
        lane, c = lanes[er], new[er]
        self.tri[lane, at] = np.stack((a, b, c), 1)
        ua, ub, uc = self.u[lane, a], self.u[lane, b], self.u[lane, c]
        bc = np.cross(ub, uc)
        with np.errstate(divide="ignore", invalid="ignore"):
            det = (ua * bc).sum(1)
            self.v[lane, at] = (self.h[lane, a][:, None] * bc + self.h[lane, b][:, None] * np.cross(uc, ua) + self.h[lane, c][:, None] * np.cross(ua, ub)) / det[:, None]
        few = np.flatnonzero(made < lost)  # whole faces went with their corners: close the gaps
        if len(few):
            some, top = lanes[few], int(self.nt[lanes[few]].max())
            spare = np.arange(len(row)) - first_lost[row] >= made[row]
            gap = np.zeros((len(lanes), top), bool)
            gap[row[spare], np.minimum(slot[spare], top - 1)] = True
            order = np.argsort(gap[few], 1, kind="stable")[:, :, None]
            self.tri[some, :top] = np.take_along_axis(self.tri[some, :top], order, 1)
            self.v[some, :top] = np.take_along_axis(self.v[some, :top], order, 1)
        self.nt[lanes] += made - lost
        top = int(self.nt[lanes].max())
        far = (self.v[lanes, :top] ** 2).sum(2)
        self.r2[lanes] = np.where(np.arange(top) < self.nt[lanes][:, None], far, 0).max(1)

    def geometry(self) -> dict[str, np.ndarray]:
        """Volume, and for each plane its area vector, first moment and number of corners.

        Each corner, face of its three and edge of that face at the corner spans a signed right
        triangle from the face's foot point over the edge's; the sums over them need no order."""
        lane = np.repeat(np.arange(self.n), self.nt)
        slot = np.arange(len(lane)) - np.repeat(np.cumsum(self.nt) - self.nt, self.nt)
        t, v = self.tri[lane, slot], self.v[lane, slot]
        planes = self.u.shape[1]
        length = np.sqrt((self.u**2).sum(2))
        length[length == 0] = 1  # places without a plane
        unit, offset = self.u / length[:, :, None], self.h / length
        size = self.n * planes
        area, moment = np.zeros((size, 3)), np.zeros((size, 3))
        for i, j, sign in ((0, 1, 1), (0, 2, -1), (1, 2, 1), (1, 0, -1), (2, 0, 1), (2, 1, -1)):
            f, g = t[:, i], t[:, j]
            uf, ug, hf, hg = unit[lane, f], unit[lane, g], offset[lane, f], offset[lane, g]
            dot = (uf * ug).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                along = (hg - hf * dot) / (1 - dot * dot)
            foot = uf * hf[:, None]
            edge = foot + (ug - uf * dot[:, None]) * along[:, None]
            a = sign * 0.5 * (np.cross(edge - foot, v - foot) * uf).sum(1)
            a = np.where(np.isfinite(a), a, 0)
            key = lane * planes + f
            middle = (foot + np.where(np.isfinite(edge), edge, 0) + v) / 3
            for k in range(3):
                area[:, k] += np.bincount(key, a * uf[:, k], size)
                moment[:, k] += np.bincount(key, a * middle[:, k], size)
        shape = (self.n, planes, 3)
        area, moment = area.reshape(shape), moment.reshape(shape)
        scalar = (area * unit).sum(2)
        corners = np.zeros(size, np.int64)
        for i in range(3):
            corners += np.bincount(lane * planes + t[:, i], minlength=size)
        return {"volume": (scalar * offset).sum(1) / 3, "area": area, "scalar": scalar, "moment": moment, "corners": corners.reshape(self.n, planes)}


def min_image(d: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Adds or takes one period where a difference exceeds half of it; at exactly half, neither."""
    return d - box * np.rint(d / box)  # half rounds to even: to none


def feet(sdf, p: np.ndarray, steps: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps along the gradient to the solid's surface: the points reached, the unit normals there,
    and where there is one.  A distance that is positive in the fluid grows into the fluid, and so
    do the normals."""
    for _ in range(steps):
        g = sdf.gradient(p)
        slope = (g * g).sum(1)
        p = p - g * (sdf.value(p) / np.where(slope > 0, slope, np.inf))[:, None]
    g = sdf.gradient(p)
    size = np.sqrt((g * g).sum(1))
    return p, g / np.where(size > 0, size, 1)[:, None], size > 0


def deepest_corners(cells: Cells, lanes: np.ndarray, seeds: np.ndarray, sdf) -> tuple[np.ndarray, np.ndarray]:
    """Of each lane's corners the one with the least distance: that distance and its place."""
    lane = np.repeat(np.arange(len(lanes)), cells.nt[lanes])
    start = np.cumsum(cells.nt[lanes]) - cells.nt[lanes]
    x = seeds[lanes[lane]] + cells.v[lanes[lane], np.arange(len(lane)) - start[lane]]
    depth = sdf.value(x)
    order = np.lexsort((depth, lane))[start]
    return depth[order], x[order]


def clip_against_solid(cells: Cells, seeds: np.ndarray, sdf, cuts: int = 24, tol: float = 1e-8) -> np.ndarray:
    """Clips cells by tangent planes of a solid, given by its signed distance (positive in the fluid).

    The first plane touches the solid nearest to the seed; each further one, under the corner that
    lies deepest in the solid, until no corner is deeper than ``tol`` or ``cuts`` planes are used.
    A plane leaves the side that its normal points to.  Cells whose seed isn't in the fluid become
    empty; returns which."""
    room = sdf.value(seeds)
    cells.empty(np.flatnonzero(room <= 0))
    lanes = np.flatnonzero((room > 0) & (cells.nt > 0) & (room - tol <= np.sqrt(cells.r2)))
    under = seeds[lanes]
    for _ in range(cuts):
        if not len(lanes):
            break
        at, normal, there = feet(sdf, under)
        lanes, at, normal = lanes[there], at[there], normal[there]
        # normal . (seed + v - at) >= 0 is what stays
        cells.clip(lanes, -normal, (normal * (seeds[lanes] - at)).sum(1), np.full(len(lanes), WALL))
        lanes = lanes[cells.nt[lanes] > 0]
        if len(lanes):
            depth, under = deepest_corners(cells, lanes, seeds, sdf)
            lanes, under = lanes[depth < -tol], under[depth < -tol]
    return room <= 0

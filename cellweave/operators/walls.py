"""Signed distances of solids (positive in the fluid), as objects for the kernel and as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..box import Box


class Solid:
    """value(points) -> distances; gradients by central differences of step ``h``."""

    h = 1e-6

    def value(self, p: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def gradient(self, p: np.ndarray) -> np.ndarray:
        out = np.empty_like(p)
        for k in range(3):
            d = np.zeros(3)
            d[k] = self.h
            out[:, k] = (self.value(p + d) - self.value(p - d)) / (2 * self.h)
        return out

    def hessian(self, p: np.ndarray) -> np.ndarray:
        """Symmetrised second differences."""
        h, out = max(self.h, 1e-4), np.empty((len(p), 3, 3))
        for k in range(3):
            d = np.zeros(3)
            d[k] = h
            out[:, :, k] = (self.gradient(p + d) - self.gradient(p - d)) / (2 * h)
        return (out + out.transpose(0, 2, 1)) / 2


@dataclass(frozen=True)
class HalfSpace(Solid):
    """Solid where (p - origin) . normal < 0."""

    origin: tuple[float, float, float]
    normal: tuple[float, float, float]

    def value(self, p):
        n = np.array(self.normal, float)
        return (p - np.array(self.origin)) @ (n / np.sqrt(n @ n))


@dataclass(frozen=True)
class Sphere(Solid):
    centre: tuple[float, float, float]
    radius: float
    inside: bool = False  # is the fluid inside?

    def value(self, p):
        d = np.sqrt(((p - np.array(self.centre)) ** 2).sum(1)) - self.radius
        return -d if self.inside else d


@dataclass(frozen=True)
class Brick(Solid):
    centre: tuple[float, float, float]
    half: tuple[float, float, float]
    inside: bool = False

    def value(self, p):
        q = np.abs(p - np.array(self.centre)) - np.array(self.half)
        d = np.sqrt((np.maximum(q, 0) ** 2).sum(1)) + np.minimum(q.max(1), 0)
        return -d if self.inside else d


@dataclass(frozen=True)
class HollowCylinder(Solid):
    """Fluid between two radii about an axis along z through the centre."""

    centre: tuple[float, float]
    inner: float
    outer: float

    def value(self, p):
        r = np.sqrt(((p[:, :2] - np.array(self.centre)) ** 2).sum(1))
        return np.minimum(r - self.inner, self.outer - r)


@dataclass(frozen=True)
class PeriodicSpheres(Solid):
    """Union of solid spheres in a periodic box; differences are rounded to the nearest image."""

    centres: tuple[tuple[float, float, float], ...]
    radii: tuple[float, ...]
    box: Box = field(default_factory=Box)

    def value(self, p):
        c, r, out = np.array(self.centres, float), np.array(self.radii, float), np.empty(len(p))
        edge = self.box.edges
        for lo in range(0, len(p), 4096):
            d = p[lo : lo + 4096, None] - c[None]
            d -= edge * np.round(d / edge)
            out[lo : lo + 4096] = (np.sqrt((d * d).sum(2)) - r).min(1)
        return out


@dataclass(frozen=True)
class SampledGrid(Solid):
    """Trilinear interpolation of values[i, j, k] at origin + step * (i, j, k), clamped at the rim."""

    values: np.ndarray
    origin: tuple[float, float, float]
    step: tuple[float, float, float]

    @classmethod
    def from_table(cls, grid: DataFrame, origin, step) -> "SampledGrid":
        """``i, j, k, value`` rows, whose number is the grid's size."""
        t = grid.select("i", "j", "k", "value").toPandas()
        v = np.zeros(tuple(int(t[c].max()) + 1 for c in "ijk"), np.float32)
        v[t["i"], t["j"], t["k"]] = t["value"]
        return cls(v, origin, step)

    def value(self, p):
        shape = np.array(self.values.shape)
        q = np.clip((p - np.array(self.origin)) / np.array(self.step), 0, shape - 1)
        i = np.minimum(q.astype(int), np.maximum(shape - 2, 0))
        f = q - i
        out = np.zeros(len(p))
        for c in range(8):
            b = np.array([c & 1, c >> 1 & 1, c >> 2 & 1])
            at = np.minimum(i + b, shape - 1)
            out += np.where(b, f, 1 - f).prod(1) * self.values[at[:, 0], at[:, 1], at[:, 2]]
        return out


def spheres_distance(points: DataFrame, spheres: DataFrame, box: Box | float) -> DataFrame:
    """``cell_id, distance`` to a table of spheres ``cx, cy, cz, r`` (a small, stated set).

    The spheres travel as one array of a single row; their number is checked before they are gathered."""
    box = Box.of(box)
    rows = spheres.select(*[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "cz", "r")])
    if rows.limit(100_001).count() > 100_000:
        raise ValueError("more spheres than one row should hold; use neighbour_pairs for many")
    every = rows.agg(F.collect_list(F.struct("cx", "cy", "cz", "r")).alias("every")).scalar()

    def one(s: Column) -> Column:
        d = [F.col(a) - s[f"c{a}"] for a in "xyz"]
        d = [x - e * F.round(x / e) for x, e in zip(d, box.edges.tolist())]
        return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) - s["r"]

    held = points.select("cell_id", "x", "y", "z", every.alias("every"))
    return held.select("cell_id", F.array_min(F.transform("every", one)).alias("distance"))


def wall_force(facets: DataFrame, cells: DataFrame, solid: Solid) -> DataFrame:
    """``cell_id, fx, fy, fz``: the part of dV/dx of each cell that its wall facets bring, to be added
    to minus the sum of (vx, vy, vz) over its other facets.

    A flat wall stays where it is as the seed moves, which takes back the area vector; a curved one
    turns with the seed's foot point, by the distance's second derivatives."""
    f = facets.where("nbr_id = -2").join(cells.select("cell_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz")), "cell_id")
    f = f.select("cell_id", "area", *[f"{p}{c}" for p in "acs" for c in "xyz"])

    def run(batches):
        for b in batches:
            get = lambda p: np.stack([np.asarray(b.column(b.schema.get_field_index(f"{p}{c}"))) for c in "xyz"], 1)
            area, bend = np.asarray(b.column(1)), solid.hessian(get("s"))
            force = -get("a") + area[:, None] * np.einsum("nij,nj->ni", bend, get("c"))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(force[:, k]) for k in range(3)]], names=["cell_id", "fx", "fy", "fz"])

    parts = f.mapInArrow(run, "cell_id long, fx double, fy double, fz double")
    return parts.groupBy("cell_id").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in "xyz"])

"""Column functions: periodic geometry, binning, equation of state, signed distances.

Everything here is an expression of built-in functions, so it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..box import Box


def wrap(x: Column, length: float) -> Column:
    """A coordinate brought into [0, length)."""
    return x - F.lit(length) * F.floor(x / length)


def min_image(d: Column, length: float) -> Column:
    """A difference of coordinates brought next to 0 by one period; at exactly half, unchanged."""
    return F.when(d > length / 2, d - length).when(d < -length / 2, d + length).otherwise(d)


def bin_index(x: Column, length: float, bins: int) -> Column:
    return F.pmod(F.floor(x * (bins / length)), F.lit(bins)).cast("int")


def bin_id(x: Column, y: Column, z: Column, box: Box, bins: tuple[int, int, int]) -> Column:
    i, j, k = (bin_index(c, e, n).cast("long") for c, e, n in zip((x, y, z), box.edges.tolist(), bins))
    return i + bins[0] * (j + bins[1] * k)


def morton(i: Column, j: Column, k: Column) -> Column:
    """Z-order code of three indices below 2^21: their bits interleaved."""
    steps = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))

    def spread(c: Column) -> Column:
        c = c.cast("long")
        for shift, mask in steps:
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(i).bitwiseOR(F.shiftleft(spread(j), 1)).bitwiseOR(F.shiftleft(spread(k), 2))


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def plane_offset(r: tuple[Column, ...], w_self: Column | float = 0.0, w_nbr: Column | float = 0.0) -> Column:
    """Offset of the plane between a seed and its neighbour at r: r . v <= offset."""
    return (dot(r, r) + w_self - w_nbr) / 2


def reach2(r2_max: Column, w_self: Column | float = 0.0, w_max: float = 0.0) -> Column:
    """Square of the distance beyond which no seed can cut a cell of squared radius ``r2_max``."""
    gap = F.greatest(F.lit(w_max) - w_self, F.lit(0.0))
    return F.pow(F.sqrt(r2_max) + F.sqrt(r2_max + gap), 2)


def eos_pressure(volume: Column, pressure: float, mean_volume: float | Column) -> Column:
    """Isothermal: pressure times mean volume over volume; 0 without a volume."""
    return F.when(volume > 0, F.lit(pressure) * mean_volume / volume).otherwise(F.lit(0.0))


def sphere_distance(x: Column, y: Column, z: Column, centre: tuple[float, float, float], radius: float) -> Column:
    """Signed distance to a solid sphere, positive outside."""
    return F.sqrt(F.pow(x - centre[0], 2) + F.pow(y - centre[1], 2) + F.pow(z - centre[2], 2)) - radius

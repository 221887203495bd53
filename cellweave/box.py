"""The periodic box and the sizes derived from it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Box:
    """Edge lengths; the box starts at the origin and is periodic in each direction."""

    x: float = 1.0
    y: float = 1.0
    z: float = 1.0

    @classmethod
    def of(cls, value: "Box | float | tuple[float, float, float]") -> "Box":
        if isinstance(value, Box):
            return value
        return cls(*value) if isinstance(value, (tuple, list)) else cls(value, value, value)

    @property
    def edges(self) -> np.ndarray:
        return np.array([self.x, self.y, self.z], float)

    @property
    def volume(self) -> float:
        return self.x * self.y * self.z

    def spacing(self, n: int) -> float:
        """The edge of a cube that holds one of n points on average."""
        return (self.volume / max(n, 1)) ** (1 / 3)

    def bins(self, n: int, each: float) -> tuple[int, int, int]:
        """Bins per axis for about ``each`` points in a bin."""
        edge = (each * self.volume / max(n, 1)) ** (1 / 3)
        return tuple(max(1, int(e / edge)) for e in self.edges)

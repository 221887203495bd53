"""Blocks of about equally many seeds, however they lie: a tree of cuts with a halo for each leaf."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..box import Box

#: Seeds, chosen by a hash of their ids, that the cuts are fitted to, and most blocks: some 32 of the
#: sample lie in each.  Tables of fewer seeds are taken whole.  Neither bounds what is tessellated.
SAMPLE, MOST = 1 << 20, 1 << 15
#: No block's spacing is taken for less than this share of the mean one (seeds in one place).
LEAST_SPACING = 1 / 256
#: Copies of seeds made at a time.
COPIES = 400_000


class Blocks:
    """The box halved again and again, each time across its seeds' longest extent, where the shares
    of the seeds are those of the blocks on each side.  ``spacing`` is each block's own."""

    def __init__(self, box: Box, sample: np.ndarray, n: int, blocks: int):
        self.edges = box.edges
        self.axis, self.split, self.below, self.lo, self.hi, self.leaf = [], [], [], [], [], []
        spacing: list[float] = []
        share = n / max(1, len(sample))
        least = LEAST_SPACING * box.spacing(n)

        def node(lo: np.ndarray, hi: np.ndarray) -> int:
            for a, v in ((self.axis, 0), (self.split, 0.0), (self.below, (-1, -1)), (self.lo, lo), (self.hi, hi), (self.leaf, -1)):
                a.append(v)
            return len(self.axis) - 1

        todo = [(node(np.zeros(3), self.edges.copy()), sample, blocks)]
        while todo:
            at, pts, m = todo.pop()
            extent = np.ptp(pts, axis=0) if len(pts) else self.edges
            k = int(extent.argmax())
            if m < 2 or len(pts) < 2 or extent[k] == 0:
                self.leaf[at] = len(spacing)
                wide, held = np.sort(extent)[::-1], max(1.0, len(pts) * share)
                # as in space, in a plane or on a line, whichever the seeds fill
                spacing.append(max(least, (wide.prod() / held) ** (1 / 3), (wide[0] * wide[1] / held) ** 0.5 if wide[2] == 0 else 0, wide[0] / held))
                continue
            c = pts[:, k]
            place = len(c) * (m // 2) // m
            value = np.partition(c, place)[place]
            above = c[c > value]
            cuts = [v for v in (value, above.min() if len(above) else None) if v is not None and (c < v).any()]
            cut = min(cuts, key=lambda v: abs(int((c < v).sum()) - place))
            left = c < cut
            few = min(m - 1, max(1, round(m * float(left.mean()))))
            lo, hi = self.lo[at], self.hi[at]
            hi_left, lo_right = hi.copy(), lo.copy()
            hi_left[k] = lo_right[k] = cut
            a, b = node(lo, hi_left), node(lo_right, hi)
            self.axis[at], self.split[at], self.below[at] = k, float(cut), (a, b)
            todo += [(a, pts[left], few), (b, pts[~left], m - few)]
        self.axis, self.split, self.below, self.leaf = np.array(self.axis), np.array(self.split), np.array(self.below), np.array(self.leaf)
        self.lo, self.hi, self.spacing = np.array(self.lo), np.array(self.hi), np.array(spacing)

    @classmethod
    def fitted(cls, seeds: DataFrame, box: Box, n: int, each: int, cores: int) -> "Blocks":
        """About ``each`` seeds in a block, fewer while there are less blocks than cores."""
        if n > SAMPLE:
            seeds = seeds.where(F.pmod(F.xxhash64("cell_id"), F.lit(-(-n // SAMPLE))) == 0)
        t = seeds.select("x", "y", "z").toArrow()
        pos = np.stack([t[c].to_numpy() for c in "xyz"], 1)
        return cls(box, pos, n, int(max(1, min(MOST, n // max(64, min(each, n // max(1, 2 * cores)))))))

    def __len__(self) -> int:
        return len(self.spacing)

    def _per_node(self, reach: np.ndarray) -> np.ndarray:
        """The greatest reach of the blocks in each node (children come after their parents)."""
        out = np.where(self.leaf >= 0, reach[self.leaf], -1.0)
        for at in range(len(out) - 1, -1, -1):
            if self.leaf[at] < 0:
                out[at] = out[self.below[at]].max()
        return out

    def _gap2(self, pos: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Square of the distance to the node's box, over the period."""
        lo, hi = self.lo[node], self.hi[node]
        gaps = [np.maximum(np.maximum(lo - p, p - hi), 0) for p in (pos, pos + self.edges, pos - self.edges)]
        return (np.minimum(np.minimum(gaps[0], gaps[1]), gaps[2]) ** 2).sum(1)

    def near(self, pos: np.ndarray, per_node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row with each block that it belongs to or that reaches it: row, block, whether its own."""
        row, node, own = np.arange(len(pos)), np.zeros(len(pos), np.int64), np.ones(len(pos), bool)
        found = []
        while len(row):
            end = self.leaf[node] >= 0
            found.append((row[end], self.leaf[node[end]], own[end]))
            row, node, own = row[~end], node[~end], own[~end]
            left = pos[row, self.axis[node]] < self.split[node]
            parts = []
            for side, mine in ((0, own & left), (1, own & ~left)):
                child = self.below[node, side]
                reach = per_node[child]
                keep = (reach >= 0) & (mine | (self._gap2(pos[row], child) <= reach * reach))
                parts.append((row[keep], child[keep], mine[keep]))
            row, node, own = (np.concatenate(x) for x in zip(*parts))
        return tuple(np.concatenate(x) for x in zip(*found))

    def replicated(self, seeds: DataFrame, reach: np.ndarray) -> DataFrame:
        """A row for each block that owns the seed or has it within its ``reach``, with ``block`` and
        ``is_owned``; blocks of a negative reach get none.  Partitions of at most a few blocks."""
        return self._copies(seeds, reach).repartition(max(1, 2 * int((reach >= 0).sum())), "block")

    def _copies(self, seeds: DataFrame, reach: np.ndarray) -> DataFrame:
        per_node = self._per_node(reach)
        step = int(max(1, COPIES // (1 + (reach > self.edges.min() / 8).sum())))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    pos = np.stack([some.column(c).to_numpy() for c in "xyz"], 1)
                    row, block, own = self.near(pos, per_node)
                    out = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block), pa.array(own)], names=[*out.schema.names, "block", "is_owned"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seeds.schema) + ", block long, is_owned boolean"
        return seeds.mapInArrow(spread, schema)

    def owners(self, seeds: DataFrame) -> np.ndarray:
        """The blocks that own any of the seeds, at most ``MOST`` numbers."""
        own = self._copies(seeds.select("x", "y", "z"), np.zeros(len(self))).where("is_owned")
        return np.array([r.block for r in own.select("block").distinct().collect()], np.int64)

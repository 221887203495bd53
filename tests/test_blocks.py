"""Balanced blocks: sizes, halos, and cells that don't depend on how the box is cut."""

import numpy as np
import pytest

from cellweave.box import Box
from cellweave.operators.tessellate import build_cells, tessellate
from cellweave.plans.blocks import Blocks


def seeds_of(kind, n, rng):
    if kind == "uniform":
        return rng.random((n, 3))
    if kind == "cluster":
        return (0.5 + 0.01 * rng.standard_normal((n, 3))) % 1
    if kind == "wall":
        return np.concatenate((rng.random((n, 2)), 0.02 * rng.random((n, 1))), 1)
    k = round(n ** (1 / 3))
    return (np.stack(np.meshgrid(*[np.arange(k)] * 3), -1).reshape(-1, 3) + 0.5) / k


@pytest.mark.parametrize("kind", ["uniform", "cluster", "wall", "lattice"])
def test_blocks_are_even_and_halos_are_whole(kind):
    rng = np.random.default_rng(3)
    pos = seeds_of(kind, 2_744, rng)
    blocks = Blocks(Box(), pos, len(pos), 13)
    reach = rng.random(len(blocks)) * 0.3
    reach[2] = -1
    row, block, own = blocks.near(pos, blocks._per_node(reach))
    held = np.bincount(block[own], minlength=len(blocks))
    assert len(blocks) == 13 and held[2] == 0 and held.max() <= 2 * len(pos) / 13
    assert len(set(zip(row, block))) == len(row) and np.bincount(row[own]).max() == 1
    got = set(zip(row.tolist(), block.tolist()))
    for b in np.flatnonzero(reach >= 0):
        mine = pos[row[own & (block == b)]]
        d = pos[:, None] - mine[None, ::7]
        close = (((d - np.rint(d)) ** 2).sum(2) <= reach[b] ** 2).any(1)
        assert {(i, b) for i in np.flatnonzero(close).tolist()} <= got


def test_seeds_in_one_place_and_none():
    same = np.full((50, 3), 0.25)
    assert len(Blocks(Box(), same, 50, 8)) == 1
    assert len(Blocks(Box(), same[:0], 0, 1)) == 1


@pytest.mark.parametrize("kind,weighted", [("uniform", False), ("cluster", False), ("cluster", True), ("wall", False)])
def test_cells_do_not_depend_on_the_blocks(spark, kind, weighted):
    rng = np.random.default_rng(5)
    pos = seeds_of(kind, 700, rng)
    w = rng.random(700) * 1e-6 if weighted else np.zeros(700)
    df = spark.createDataFrame([(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(pos, w))], "cell_id long, x double, y double, z double, w double")
    got = tessellate(df, 1.0, weighted=weighted, block_seeds=70, topology=False).select("cell_id", "volume", "n_facets", "status").toPandas().sort_values("cell_id")
    cells, status, _ = build_cells(pos, np.arange(700), w if weighted else None, np.ones(700, bool), np.ones(3), 700, np.inf, float(w.max()))
    assert (got["status"].to_numpy() == status).all()
    np.testing.assert_allclose(got["volume"].to_numpy(), np.where(cells.nt == 0, 0, cells.geometry()["volume"]), rtol=1e-9, atol=1e-14)
    if not weighted:  # seeds that a weight covers are empty, and nobody has their place
        assert abs(got["volume"].sum() - 1) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9])
def test_few_seeds_partition_the_box_by_all_images(n):
    rng = np.random.default_rng(n)
    pos = rng.random((n, 3))
    cells, _, _ = build_cells(pos, np.arange(n), None, np.ones(n, bool), np.ones(3), n, np.inf)
    volume = cells.geometry()["volume"]
    assert abs(volume.sum() - 1) < 1e-12
    probes = rng.random((40_000, 3))
    d = probes[:, None] - pos[None]
    nearest = ((d - np.rint(d)) ** 2).sum(2).argmin(1)
    np.testing.assert_allclose(np.bincount(nearest, minlength=n) / len(probes), volume, atol=0.015)

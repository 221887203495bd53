import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import distributed, optimize
from cellweave.operators.tessellate import tessellate
from cellweave.plans import staged
from cellweave.sources import from_arrays, to_array


def points(n, seed=3):
    return np.random.default_rng(seed).random((n, 3))


def test_products_equal_the_drivers(spark):
    n = 60
    x, rng = points(n), np.random.default_rng(1)
    s = optimize.Evaluator(None, optimize.Box())(x, None)
    h = optimize._jacobian(s, np.ones(n))
    cells = staged(tessellate(from_arrays(spark, x), topology=False).select("cell_id", "volume", "facets"), "test")
    j = distributed.Jacobian(cells, 3)
    p, y = rng.random((n, 3)), rng.random(n)
    forward = to_array(j.forward(from_arrays(spark, p).withColumnsRenamed({c: f"p{c}" for c in "xyz"})), "value")
    assert np.allclose(forward, h.forward(p), atol=1e-12)
    values = from_arrays(spark, p, value=y).select("cell_id", "value")
    assert np.allclose(to_array(j.back(values), "gx", "gy", "gz"), h.back(y), atol=1e-12)
    assert np.allclose(to_array(j.back(values, square=True), "gx", "gy", "gz") + 1e-12, optimize.Normal(h.cell, h.node, h.coef, y, n).diagonal(), atol=1e-12)
    j.drop()


def test_steps_equal_the_drivers(spark):
    n = 50
    x = points(n, 8)
    r = optimize.optimize_volume_mesh(x, np.full(n, 1 / n), max_newton=2, cg_iters=4)
    got = distributed.volume_mesh(from_arrays(spark, x, ref=np.full(n, 1 / n)), max_newton=2, cg_iters=4)
    assert np.allclose(to_array(got.positions, "x", "y", "z"), r.positions, atol=1e-9)
    assert got.iters == r.iters == 2 and not got.converged and got.max_vol_err == pytest.approx(r.max_vol_err, rel=1e-6)


def test_an_even_lattice_and_an_empty_table_are_done(spark):
    x = (np.stack(np.meshgrid(*[np.arange(3)] * 3), -1).reshape(-1, 3) + 0.5) / 3
    seeds = from_arrays(spark, x, ref=np.full(27, 1 / 27))
    got = distributed.volume_mesh(seeds, max_newton=3)
    assert got.converged and got.iters == 0 and got.n_empty == 0 and got.max_vol_err < 1e-12
    none = distributed.volume_mesh(seeds.where(F.lit(False)))
    assert none.converged and none.positions.count() == 0

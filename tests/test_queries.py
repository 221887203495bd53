"""Every query against its SQL on the smallest tables, if they are there."""

import math
import os

import duckdb
import pytest

from cellweave import queries as Q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(df):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df), key=str)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    out = Q.QUERIES[name](spark, DIR)
    want = c.sql(Q.SQL[name])
    cols = sorted(out.columns)
    assert cols == sorted(want.columns)
    got, want = (rows(map(tuple, d.values.tolist())) for d in (out.toPandas()[cols], want.df()[cols]))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-4) if name == "velocity_gradient" else a == b


def test_sections_tile_the_plane_and_solids_fill_the_box(spark):
    assert sum(r["area"] for r in Q.cell_sections(spark, DIR).collect()) == pytest.approx(1, abs=1e-5)
    solids = Q.cell_polyhedra(spark, DIR).collect()
    assert sum(r["volume"] for r in solids) == pytest.approx(1, abs=1e-6)
    assert all(r["points"] == 2 * r["faces"] - 4 for r in solids)


def test_optimisers_run_to_their_end_and_say_how_they_ended(spark):
    mesh = Q.volume_mesh(spark, DIR).first()
    assert mesh["converged"] and 3 < mesh["iters"] < 60
    assert 0 <= mesh["mean_vol_err"] <= mesh["max_vol_err"] < 1e-9
    face = Q.interface_mesh(spark, DIR).first()
    assert face["converged"] or face["iters"] == 60
    assert face["energy"] > 0 and face["energy_ratio"] < 0.7

"""Projection of Gaussian tables: by scales in tasks, by one scale a pass, on given and bounded grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mwspark.functions import gaussians as G
from mwspark.functions.shared import write_shared
from mwspark.mra import MRA, World
from mwspark.operators import project, reduce

M = MRA(World(2, -1, (-1, -1), (2, 2)), 5, "interpolating", 12)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [("many", i, float(rng.normal()), (10 ** rng.uniform(1, 2, 2)).tolist(), rng.uniform(-0.5, 0.5, 2).tolist(), rng.integers(0, 2, 2).tolist()) for i in range(40)]
    rows += [("narrow", 0, 1.0, [30.0, 20.0], [0.3, -0.7], [0, 0]), ("far", 0, 1.0, [900.0, 900.0], [50.0, 50.0], [0, 0])]
    return spark.createDataFrame(rows, G.ROW)


def leaves(t):
    return {(r.tree_id, r.n, r.lx, r.ly): np.array(r.coef) for r in t.where("is_end").collect()}


def test_norms_are_those_of_closed_forms(spark, table):
    t = write_shared(project.project_gaussians(table, M, 1e-6))
    got = {r.tree_id: r.square_norm for r in reduce.square_norm(t).collect()}
    want = {r.fn_id: r.square_norm for r in G.square_norms(table, 2).collect()}
    assert got["many"] == pytest.approx(want["many"], rel=1e-6) and got["narrow"] == pytest.approx(want["narrow"], rel=1e-6) and got["far"] == 0
    inner = t.where("not is_end").count()
    assert t.where("is_end").count() == inner * 3 + 4 * 3  # four roots a tree; whoever splits has four children


def test_heavy_cells_and_many_passes_give_the_same_trees(spark, table, monkeypatch):
    want = leaves(project.project_gaussians(table, M, 1e-4))
    monkeypatch.setattr(project, "SCALES", {1: 1, 2: 1, 3: 1})
    one = leaves(project.project_gaussians(table, M, 1e-4))
    monkeypatch.setattr(project, "LIGHT", 6)
    heavy = leaves(project.project_gaussians(table, M, 1e-4))
    assert one.keys() == heavy.keys() and all(np.allclose(one[k], heavy[k]) for k in one)
    same = want.keys() & one.keys()  # a tree's norm is known a little later where scales are done in tasks
    assert len(same) > 0.97 * max(len(want), len(one)) and all(np.allclose(want[k], one[k]) for k in same)


@pytest.mark.parametrize("most", [0, 1, 2, 5])
def test_bounded_depth(spark, table, most):
    got = leaves(project.project_gaussians(table, M, 1e-12, max_iter=most))
    depth = {name: max(k[1] for k in got if k[0] == name) + 1 for name in ("many", "narrow")}
    assert depth == {"many": most, "narrow": most}
    for name in ("many", "narrow", "far"):
        assert sum(4.0 ** -k[1] for k in got if k[0] == name) == 16  # the leaves cover the world


def test_start_grid(spark, table):
    cells = spark.createDataFrame([("narrow", 1, x, y, 0) for x in range(-4, 4) for y in range(-4, 4)], "tree_id string, n int, lx int, ly int, lz int")
    fixed = leaves(project.project_gaussians(table.where("fn_id = 'narrow'"), M, -1.0, start=cells))
    assert len(fixed) == 64 and all(k[1] == 1 for k in fixed)
    t = project.project_gaussians(table.where("fn_id = 'narrow'"), M, 1e-6, start=cells)
    got = reduce.square_norm(t).first().square_norm
    assert got == pytest.approx(np.pi / (2 * 600**0.5), rel=1e-6) and t.where(F.col("is_end") & (F.col("n") < 1)).count() == 0


def test_a_very_narrow_function_is_found_by_its_hints(spark):
    beta, at = 1e7, np.array([0.2371, -0.6113])
    f = lambda x: np.exp(-beta * ((x - at) ** 2).sum(1))
    width = 1 / np.sqrt(2 * beta)
    visible = lambda n, low, high: 2.0**-n < 4 * width
    zero = lambda low, high: ((low > at + 7 * width) | (high < at - 7 * width)).any(1)
    ids = spark.createDataFrame([("f",)], "tree_id string")
    start = write_shared(project.hinted_grid(project.start_grid(ids, M), M, visible, zero))
    blind = reduce.square_norm(project.project_function(spark, M, f, 1e-6)).first().square_norm
    t = write_shared(project.project_function(spark, M, f, 1e-6, start=start))
    assert blind < 1e-20 and reduce.square_norm(t).first().square_norm == pytest.approx(np.pi / (2 * beta), rel=1e-8)
    cells = start.count()
    assert cells < 300 and sum(4.0 ** -r.n for r in start.collect()) == 16
    one = project.hinted_grid(project.start_grid(ids, M), M, visible, zero, scales=1)
    assert set(one.collect()) == set(start.collect())

import numpy as np
import pytest
from pyspark.sql import functions as F

from mwspark.functions import gaussians as G
from mwspark.functions.trees import write_shared
from mwspark.mra import MRA, TREE_KEY, World
from mwspark.operators import arith, derivative, grid, keys, linalg, project, reduce, transform
from mwspark.sources import trees as sources

M = MRA(World(1, -1, (-1,), (2,)), 5)
TERMS = "out_id string, tree_id string, c double"


def one(df, col):
    return {r["tree_id"]: r[col] for r in df.collect()}


@pytest.fixture(scope="module")
def gauss(spark):
    rows = [("a", 0, (110 / np.pi) ** 0.5, [110.0], [-0.25], [0]), ("b", 0, (50 / np.pi) ** 0.5, [50.0], [-0.2], [0])]
    return spark.createDataFrame(rows, G.ROW)


@pytest.fixture(scope="module")
def trees(gauss):
    return write_shared(project.project_gaussians(gauss, M, 1e-6))


def test_projection_matches_closed_forms(spark, gauss, trees):
    assert one(reduce.integrate(trees, M), "integral") == pytest.approx({"a": 1, "b": 1}, abs=1e-8)
    exact = {r[0]: r[1] for r in G.square_norms(gauss, 1).collect()}
    assert one(reduce.square_norm(trees), "square_norm") == pytest.approx(exact, rel=1e-8)
    pair = spark.createDataFrame([("a", "b")], "bra_id string, ket_id string")
    want = G.overlaps(pair.toDF("a_id", "b_id"), gauss, gauss, 1).first()["overlap"]
    assert reduce.dot_pairs(pair, trees, trees, M).first()["dot"] == pytest.approx(want, rel=1e-8)
    assert reduce.node_norm_dot(pair, trees, trees, M).first()["bound"] >= 0.95 * want  # nearly a bound: norms below a leaf are estimates


def test_structure_is_a_tree(trees):
    inner = trees.where("not is_end")
    kids = keys.children(inner.select(*TREE_KEY), 1).select(*TREE_KEY)
    assert kids.join(trees, TREE_KEY, "left_anti").isEmpty()
    assert keys.end_nodes(trees).count() == trees.where("is_end").count()
    assert trees.groupBy(*TREE_KEY).count().where("count > 1").isEmpty()


def test_sums_products_maps(spark, trees):
    s = arith.add(spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0)], TERMS), trees, M)
    assert one(reduce.integrate(s, M), "integral")["s"] == pytest.approx(3, abs=1e-8)
    zero = arith.add(spark.createDataFrame([("z", "a", 1.0), ("z", "a", -1.0)], TERMS), trees, M)
    assert one(reduce.square_norm(zero), "square_norm")["z"] == pytest.approx(0, abs=1e-20)
    square = arith.square(trees, M)
    norm = one(reduce.square_norm(trees), "square_norm")
    assert one(reduce.integrate(square, M), "integral") == pytest.approx(norm, rel=1e-7)
    assert one(reduce.square_norm(arith.normalize(trees, M)), "square_norm") == pytest.approx({"a": 1, "b": 1})
    assert one(reduce.integrate(arith.absadd(trees, trees, M, 2.0), M), "integral")["a"] == pytest.approx(5 * norm["a"], rel=1e-3)


def test_refine_crop_and_push_down_keep_the_function(trees):
    finer = grid.refine_uniform(trees, M)
    assert one(reduce.square_norm(finer), "square_norm") == pytest.approx(one(reduce.square_norm(trees), "square_norm"))
    assert grid.crop(trees, M, 1e-2).count() < trees.count()
    assert grid.crop(trees, M, -1).count() == trees.count()
    again = transform.rebuild(trees.where("is_end").select(*TREE_KEY, "coef"), M)
    assert again.count() == trees.count()
    down = transform.reconstruct_down(trees, M).select(*TREE_KEY, F.col("coef").alias("c2"))
    worst = trees.join(down, TREE_KEY).select(F.max(F.aggregate(F.zip_with("coef", "c2", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, x)))).first()[0]
    assert worst < 1e-10


def test_evaluation_and_derivative(spark, gauss, trees):
    p = spark.createDataFrame([(1, "a", -0.21), (2, "b", 0.05), (3, "b", 7.0)], "pid long, tree_id string, x double")
    got = {r[0]: r[2] for r in reduce.evaluate(p, trees, M, precise=True).collect()}
    exact = {r["pid"]: r["value"] for r in G.evaluate(p.withColumnRenamed("tree_id", "fn_id"), gauss, 1, by=["fn_id"]).collect()}
    assert got[1] == pytest.approx(exact[1], rel=1e-5) and got[2] == pytest.approx(exact[2], rel=1e-4) and got[3] == 0
    d = derivative.apply(trees, M, 0)
    want = {r[0]: r[1] for r in G.square_norms(G.differentiate(gauss, 0), 1).collect()}
    assert one(reduce.square_norm(d), "square_norm") == pytest.approx(want, rel=1e-3)


def test_overlap_and_orthonormal_set(spark, trees):
    s = {(r.i, r.j): r.re for r in linalg.overlap_matrix(trees, M).collect()}
    assert s["a", "b"] == pytest.approx(s["b", "a"])
    o = {(r.i, r.j): r.re for r in linalg.overlap_matrix(linalg.orthonormalize(trees, M), M).collect()}
    assert o["a", "a"] == pytest.approx(1) and abs(o["a", "b"]) < 1e-9
    rest = linalg.orthogonalize(trees.where("tree_id = 'a'"), trees.where("tree_id = 'b'"), M)
    assert abs(linalg.cross_overlap(rest, trees.where("tree_id = 'b'"), M).first().re) < 1e-8


def test_save_and_load(spark, trees, tmp_path):
    sources.save_trees(trees, str(tmp_path / "t"))
    back = sources.load_trees(spark, str(tmp_path / "t"), M)
    assert back.count() == trees.count()
    assert one(reduce.square_norm(back), "square_norm") == pytest.approx(one(reduce.square_norm(trees), "square_norm"), abs=1e-12)


def test_results_do_not_depend_on_partitions(trees):
    a = one(reduce.integrate(trees.repartition(1), M), "integral")
    assert one(reduce.integrate(trees.repartition(8), M), "integral") == pytest.approx(a, abs=1e-13)


def test_gaussian_products_and_overlaps_with_powers(spark):
    g = spark.createDataFrame([("p", 0, 1.3, [1.1], [0.2], [2]), ("q", 0, 0.7, [0.6], [-0.4], [1])], G.ROW)
    x = np.linspace(-12, 12, 200001)
    p = 1.3 * (x - 0.2) ** 2 * np.exp(-1.1 * (x - 0.2) ** 2)
    q = 0.7 * (x + 0.4) * np.exp(-0.6 * (x + 0.4) ** 2)
    pair = spark.createDataFrame([("p", "q")], "a_id string, b_id string")
    assert G.overlaps(pair, g, g, 1).first()["overlap"] == pytest.approx((p * q).sum() * (x[1] - x[0]), rel=1e-9)
    prod = G.multiply(pair.withColumn("out_id", F.lit("r")), g, g, 1)
    at = spark.createDataFrame([(1, 0.3)], "pid long, x double")
    want = 1.3 * 0.1**2 * np.exp(-1.1 * 0.01) * 0.7 * 0.7 * np.exp(-0.6 * 0.49)
    assert G.evaluate(at, prod, 1).first()["value"] == pytest.approx(want, rel=1e-12)


def test_lookups_below_leaves_broadcast_nothing(trees):
    ends = trees.where("is_end")
    cells = keys.children(ends.select(*TREE_KEY), 1, 3).select(*TREE_KEY)
    for found in (transform.push_down(ends, cells, M), arith.lookup(trees, cells, M)):
        assert found.count() == 8 * ends.count()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def _at(found):
    return {(r["tree_id"], r["n"], r["lx"]): r["coef"] for r in found.collect()}


def test_lookups_find_nodes_and_cells_below_leaves_by_one_join(trees):
    inner, ends = trees.where("not is_end"), trees.where("is_end")
    below = keys.children(ends.select(*TREE_KEY), 1, 2).select(*TREE_KEY)
    cells = inner.select(*TREE_KEY).unionByName(ends.select(*TREE_KEY)).unionByName(below)
    found = arith.lookup(trees, cells.withColumn("mark", F.col("n") + 1), M)
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
    assert found.where("mark <> n + 1").isEmpty() and found.count() == cells.count()
    got, whole = _at(found), _at(trees) | _at(grid.refine_uniform(trees, M, 2).join(below, TREE_KEY, "left_semi"))
    assert got.keys() == whole.keys()
    assert max(np.abs(np.array(got[k]) - whole[k]).max() for k in got) < 1e-10


def test_lookups_ask_only_scales_that_hold_leaves(trees):
    ends = grid.refine_uniform(trees.where(F.col("n") == M.world.scale).withColumn("is_end", F.lit(True)), M, 2).where("is_end")
    cells = keys.children(ends.select(*TREE_KEY), 1, 3).select(*TREE_KEY)
    plan = transform.push_down(ends, cells, M)._jdf.queryExecution().optimizedPlan().toString()
    assert "an#" in plan and f"= {M.world.scale + 2})" in plan  # the keys of all other scales are left out before the join


def test_union_grid_is_one_aggregation(spark, trees):
    found = arith.union_leaves(spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0)], TERMS), trees)
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = keys.end_nodes(trees.select(F.lit("s").alias("tree_id"), *TREE_KEY[1:]).distinct())
    assert found.count() == want.count() and found.exceptAll(want).isEmpty()


def test_pair_of_trees_reads_its_table_once(spark, monkeypatch):
    from mwspark.jobs import queries

    plans = []
    write = queries.write_shared

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(queries, "write_shared", kept)
    monkeypatch.setattr(transform, "write_shared", kept)
    queries._pair(spark, "/root/testdata/sf0.001")
    assert sum("l_suppkey" in p and "l_orderkey" in p for p in plans) == 1

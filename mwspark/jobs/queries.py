"""The registered queries over the given tables, and equivalent SQL where there is one.

Points come from lineitem rows, cells from points, Gaussians from supplier rows (one function a nation), Haar (order 0) trees from
sums over part keys: one tree for each supplier, so that trees and nodes grow with the tables, and one for each return flag where
all pairs of functions are asked for. Order-1 trees in two dimensions have about as many leaves as lineitem has rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.functions import gaussians as G
from mwspark.functions import kernels as K
from mwspark.functions.shared import shared_dir
from mwspark.functions.trees import with_norms, write_shared
from mwspark.mra import MRA, TREE_KEY, World
from mwspark.operators import arith, components, convolution, derivative, grid, keys, linalg, project, reduce, transform
from mwspark.sources import trees

WORLD3 = World(3, -2, (-1, -1, -1), (2, 2, 2))
WORLD1 = World(1, 0)
HAAR = MRA(WORLD1, 0, "legendre")
WORLD2 = World(2, -1, (-1, -1), (2, 2))
LEAF = 6  # scale of the Haar scaling blocks

# Haar sums are dyadic and often lie just between two roundings; both sides add a little before they round.

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select((F.col("l_quantity") / 6.4 - 4).alias("x"), (F.col("l_discount") * 70 - 3.5).alias("y"), (F.col("l_tax") * 90 - 4).alias("z"), "l_partkey")


POINTS = "pts AS (SELECT l_quantity / 6.4 - 4 AS x, l_discount * 70 - 3.5 AS y, l_tax * 90 - 4 AS z, l_partkey FROM lineitem)"


def cells(spark: SparkSession, sf_dir: str, n: int, tree: str | None = None) -> DataFrame:
    """Distinct cells of scale n that hold points."""
    out = points(spark, sf_dir).select(*keys.point_key(WORLD3, n)).distinct()
    return out if tree is None else out.withColumn("tree_id", F.lit(tree)).select(*TREE_KEY)


def cells_sql(n: int, name: str = "cells") -> str:
    return f"{name} AS (SELECT DISTINCT {n} AS n, CAST(floor(x * {2.0**n}) AS INT) AS lx, CAST(floor(y * {2.0**n}) AS INT) AS ly, CAST(floor(z * {2.0**n}) AS INT) AS lz FROM pts)"


def gaussians(spark: SparkSession, sf_dir: str, powers: bool = False, dim: int = 2) -> DataFrame:
    k = F.col("s_suppkey")
    per = lambda a: F.array(*a[:dim])
    power = per([(k % 3).cast("int"), (k % 2).cast("int"), F.lit(0)]) if powers else per([F.lit(0)] * 3)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("fn_id"), k.cast("long").alias("term"), (F.col("s_acctbal") / 1000).alias("coef"),
        per([(k % 5 + 1).cast("double"), (k % 3 + 1).cast("double"), (k % 2 + 1).cast("double")]).alias("alpha"),
        per([k % 17 / 8.5 - 1, k % 13 / 6.5 - 1, k % 11 / 5.5 - 1]).alias("pos"), power.alias("power"),
    )


GAUSS = """gs AS (SELECT 'g' || s_nationkey AS fn_id, s_suppkey AS term, s_acctbal / 1000 AS coef,
  CAST(s_suppkey % 5 + 1 AS DOUBLE) AS a0, CAST(s_suppkey % 3 + 1 AS DOUBLE) AS a1, CAST(s_suppkey % 2 + 1 AS DOUBLE) AS a2,
  s_suppkey % 17 / 8.5 - 1 AS x0, s_suppkey % 13 / 6.5 - 1 AS x1, s_suppkey % 11 / 5.5 - 1 AS x2,
  CAST(s_suppkey % 3 AS INT) AS p0, CAST(s_suppkey % 2 AS INT) AS p1 FROM supplier)"""


FLAG, SUPPLIER = "l_returnflag", "'s' || l_suppkey"


def haar_scaling(spark: SparkSession, sf_dir: str, value: str = "l_quantity", by: str = FLAG) -> DataFrame:
    """Scaling blocks at scale LEAF: one function for each by, its value in a cell the sum of value over part keys."""
    return _haar_block(_haar_sums(spark, sf_dir, [value], by), value, by)


def _haar_sums(spark: SparkSession, sf_dir: str, values: list[str], by: str) -> DataFrame:
    """Sums of the values by cell and by tree_id; by supplier, by its key, which is shorter."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cell = (F.col("l_partkey") % 2**LEAF).cast("int").alias("lx")
    return t.groupBy("l_suppkey" if by == SUPPLIER else F.expr(by).alias("tree_id"), cell).agg(*[F.sum(v).cast("double").alias(v) for v in values])


def _haar_block(sums: DataFrame, value: str, by: str) -> DataFrame:
    return sums.select(F.expr(by if by == SUPPLIER else "tree_id").alias("tree_id"), F.lit(LEAF).alias("n"), "lx", F.lit(0).alias("ly"), F.lit(0).alias("lz"), F.array(F.col(value) * 2.0 ** (-LEAF / 2)).alias("s"))


def _haar_nodes(scaling: DataFrame, written: bool = False) -> DataFrame:
    return with_norms(transform.compress_up(scaling, HAAR, written).withColumn("is_end", F.col("n") == LEAF - 1), HAAR)


def haar(spark: SparkSession, sf_dir: str, value: str = "l_quantity", by: str = FLAG) -> DataFrame:
    """The trees above these blocks; nodes of scale LEAF - 1 are the leaves."""
    return write_shared(_haar_nodes(haar_scaling(spark, sf_dir, value, by)))


def haar_sql(value: str = "l_quantity", name: str = "leaf", by: str = FLAG) -> str:
    return f"{name} AS (SELECT {by} AS tree_id, CAST(l_partkey % {2**LEAF} AS INT) AS l, CAST(SUM({value}) AS DOUBLE) AS f FROM lineitem GROUP BY 1, 2)"


PLANE = MRA(World(2, 0), 1, "legendre")
PLANE_LEAF = 8


def plane_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-1 scaling blocks in two dimensions: f x on the cell of a part and an order, f the sum of quantities; a tree for each hundred suppliers."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = 2.0**-PLANE_LEAF
    cell = [(F.col(c) % 2**PLANE_LEAF).cast("int").alias(k) for c, k in (("l_partkey", "lx"), ("l_orderkey", "ly"))]
    sums = t.groupBy(F.concat(F.lit("p"), F.floor(F.col("l_suppkey") / 100).cast("string")).alias("tree_id"), *cell).agg(F.sum("l_quantity").cast("double").alias("f"))
    # x = side (lx + 1/2 + P1 / 2) in the cell, in orthonormal Legendre polynomials: 1 and sqrt(3) P1
    mean, slope = F.col("f") * side * (F.col("lx") + 0.5), F.col("f") * side / (2 * np.sqrt(3.0))
    return sums.select("tree_id", F.lit(PLANE_LEAF).alias("n"), "lx", "ly", F.lit(0).alias("lz"), F.array(mean * side, slope * side, F.lit(0.0), F.lit(0.0)).alias("s"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = transform.compress_up(plane_scaling(spark, sf_dir), PLANE).withColumn("is_end", F.col("n") == PLANE_LEAF - 1)
    return write_shared(with_norms(nodes, PLANE))


PLANE_SQL = f"""cell AS (SELECT 'p' || CAST(l_suppkey // 100 AS VARCHAR) AS tree_id, CAST(l_partkey % {2**PLANE_LEAF} AS INT) AS lx, CAST(l_orderkey % {2**PLANE_LEAF} AS INT) AS ly, CAST(sum(l_quantity) AS DOUBLE) AS f FROM lineitem GROUP BY 1, 2, 3)"""


# --- index and geometry ---------------------------------------------------------------------------------------------


@query("b1_root_cells", f"""WITH {POINTS}, b AS (SELECT CAST(floor(x / 4) AS INT) + 1 AS a, CAST(floor(y / 4) AS INT) + 1 AS b, CAST(floor(z / 4) AS INT) + 1 AS c FROM pts),
k AS (SELECT CAST(range AS INT) AS box FROM range(8)) SELECT box, -2 AS n, box % 2 - 1 AS lx, box // 2 % 2 - 1 AS ly, box // 4 - 1 AS lz,
(SELECT count(*) FROM b WHERE a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1 AND a + 2 * b + 4 * c = box) AS n_points FROM k""")
def _(spark, sf_dir):
    """B1 with B2: the root cells and how many points each holds."""
    held = points(spark, sf_dir).groupBy(keys.cell_of_point(WORLD3).alias("box")).agg(F.count("*").alias("n_points"))
    return keys.root_cells(spark, WORLD3).join(held, "box", "left").select("box", "n", "lx", "ly", "lz", F.coalesce("n_points", F.lit(0)).alias("n_points"))


@query("b2_cell_of_point", f"""WITH {POINTS}, b AS (SELECT floor(x / 4) + 1 AS a, floor(y / 4) + 1 AS b, floor(z / 4) + 1 AS c FROM pts)
SELECT CAST(CASE WHEN a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1 THEN a + 2 * b + 4 * c ELSE -1 END AS INT) AS box, count(*) AS n_points FROM b GROUP BY 1""")
def _(spark, sf_dir):
    return points(spark, sf_dir).groupBy(keys.cell_of_point(WORLD3).alias("box")).agg(F.count("*").alias("n_points"))


@query("b3_root_of_node", f"""WITH {POINTS}, {cells_sql(3)}, r AS (SELECT floor(lx / 32.0) + 1 AS a, floor(ly / 32.0) + 1 AS b, floor(lz / 32.0) + 1 AS c FROM cells)
SELECT CAST(CASE WHEN a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1 THEN a + 2 * b + 4 * c ELSE -1 END AS INT) AS box, count(*) AS n_cells FROM r GROUP BY 1""")
def _(spark, sf_dir):
    return cells(spark, sf_dir, 3).groupBy(keys.root_of_node(WORLD3).alias("box")).agg(F.count("*").alias("n_cells"))


@query("b4_parents", f"""WITH {POINTS}, {cells_sql(3)} SELECT n - 1 AS n, CAST(floor(lx / 2.0) AS INT) AS lx, CAST(floor(ly / 2.0) AS INT) AS ly, CAST(floor(lz / 2.0) AS INT) AS lz, count(*) AS n_children FROM cells GROUP BY 1, 2, 3, 4""")
def _(spark, sf_dir):
    return cells(spark, sf_dir, 3).groupBy(*keys.parent_key()).agg(F.count("*").alias("n_children"))


@query("b4_children", f"""WITH {POINTS}, {cells_sql(1)}, c AS (SELECT CAST(range AS INT) AS child FROM range(8))
SELECT n + 1 AS n, 2 * lx + child % 2 AS lx, 2 * ly + child // 2 % 2 AS ly, 2 * lz + child // 4 AS lz, child FROM cells, c""")
def _(spark, sf_dir):
    return keys.children(cells(spark, sf_dir, 1), 3).select("n", "lx", "ly", "lz", "child")


@query("b5_ancestors", f"""WITH {POINTS}, {cells_sql(3)}, s AS (SELECT CAST(range AS INT) AS up FROM range(6))
SELECT n - up AS an, count(*) AS n_pairs, count(DISTINCT (CAST(floor(lx / pow(2, up)) AS INT), CAST(floor(ly / pow(2, up)) AS INT), CAST(floor(lz / pow(2, up)) AS INT))) AS n_ancestors FROM cells, s GROUP BY 1""")
def _(spark, sf_dir):
    return keys.ancestors(cells(spark, sf_dir, 3), -2).groupBy("an").agg(F.count("*").alias("n_pairs"), F.countDistinct("ax", "ay", "az").alias("n_ancestors"))


@query("b6_node_bounds", f"""WITH {POINTS}, {cells_sql(2)} SELECT n, lx, ly, lz, lx * 0.25::DOUBLE AS lo_x, (lx + 1) * 0.25::DOUBLE AS hi_x, (lz + 0.5::DOUBLE) * 0.25::DOUBLE AS mid_z FROM cells""")
def _(spark, sf_dir):
    return cells(spark, sf_dir, 2).select("*", *keys.node_bounds(WORLD3)).select("n", "lx", "ly", "lz", "lo_x", "hi_x", "mid_z")


@query("b7_child_of_point", f"""WITH {POINTS}, k AS (SELECT x, y, z, floor(x) AS a, floor(y) AS b, floor(z) AS c FROM pts)
SELECT CAST((x > a + 0.5)::INT + 2 * (y > b + 0.5)::INT + 4 * (z > c + 0.5)::INT AS INT) AS child, count(*) AS n_points FROM k GROUP BY 1""")
def _(spark, sf_dir):
    p = points(spark, sf_dir).select("x", "y", "z", *keys.point_key(WORLD3, 0))
    return p.groupBy(keys.child_of_point(WORLD3).cast("int").alias("child")).agg(F.count("*").alias("n_points"))


@query("b7_child_of_node", f"""WITH {POINTS}, {cells_sql(3)} SELECT CAST(((floor(lx / 4.0)::INT % 2) + 2) % 2 + 2 * (((floor(ly / 4.0)::INT % 2) + 2) % 2) + 4 * (((floor(lz / 4.0)::INT % 2) + 2) % 2) AS INT) AS child, count(*) AS n_cells FROM cells GROUP BY 1""")
def _(spark, sf_dir):
    c = cells(spark, sf_dir, 3)
    return c.groupBy(keys.child_of_node(F.lit(0), [F.col("lx"), F.col("ly"), F.col("lz")]).alias("child")).agg(F.count("*").alias("n_cells"))


@query("b8_wrap", """SELECT CAST(((l_partkey % 1000 + 64) % 128 + 128) % 128 - 64 AS INT) AS lx, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf_dir):
    w = World(1, -2, (-1,), (2,), periodic=(True,))
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit(4).alias("n"), (F.col("l_partkey") % 1000).cast("int").alias("lx"), F.lit(0).alias("ly"), F.lit(0).alias("lz"))
    return t.select(*keys.wrap_index(w)).groupBy("lx").agg(F.count("*").alias("n"))


@query("b9_quadrature", f"""WITH {POINTS}, {cells_sql(1)} SELECT n, lx, ly, lz, CAST(1728 AS BIGINT) AS n_points, round(0.125::DOUBLE, 9) AS volume,
round(0.25::DOUBLE * (pow((lx + 1) / 2.0, 4) - pow(lx / 2.0, 4)) * 0.25::DOUBLE, 6) AS cube_x FROM cells""")
def _(spark, sf_dir):
    """Weights sum to a cell's volume, and x^3 is integrated exactly."""
    q = keys.quadrature_points(cells(spark, sf_dir, 1), MRA(WORLD3, 5))
    return q.groupBy("n", "lx", "ly", "lz").agg(F.count("*").alias("n_points"), F.round(F.sum("weight"), 9).alias("volume"), F.round(F.sum(F.col("weight") * F.pow("x", F.lit(3))), 6).alias("cube_x"))


RAGGED = f"""ragged AS (SELECT n, lx, ly, lz FROM (SELECT 1 AS n, CAST(floor(x * 2) AS INT) AS lx, CAST(floor(y * 2) AS INT) AS ly, CAST(floor(z * 2) AS INT) AS lz, count(*) AS c FROM pts GROUP BY 1, 2, 3, 4) WHERE c <= (SELECT count(*) / 1500 FROM pts)),
fine AS (SELECT DISTINCT 2 AS n, CAST(floor(x * 4) AS INT) AS lx, CAST(floor(y * 4) AS INT) AS ly, CAST(floor(z * 4) AS INT) AS lz FROM pts),
leaf AS (SELECT * FROM ragged UNION ALL SELECT f.* FROM fine f WHERE NOT EXISTS (SELECT 1 FROM ragged r WHERE r.lx = floor(f.lx / 2.0) AND r.ly = floor(f.ly / 2.0) AND r.lz = floor(f.lz / 2.0)))"""


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of scale 1 that hold few points, and those of scale 2 elsewhere."""
    p = points(spark, sf_dir)
    few = p.groupBy(*keys.point_key(WORLD3, 1)).agg(F.count("*").alias("c")).where(F.col("c") <= p.count() / 1500).drop("c")
    fine = cells(spark, sf_dir, 2)
    up = fine.select("*", *[F.shiftright(a, 1).alias("p" + a) for a in ("lx", "ly", "lz")])
    rest = up.join(few.select(*[F.col(a).alias("p" + a) for a in ("lx", "ly", "lz")]), ["plx", "ply", "plz"], "left_anti").select("n", "lx", "ly", "lz")
    return few.unionByName(rest)


@query("b10_end_node_of", f"WITH {POINTS}, {RAGGED}, {cells_sql(4, 'k')} SELECT leaf.n AS en, leaf.lx AS ex, leaf.ly AS ey, leaf.lz AS ez, count(*) AS n_keys FROM leaf JOIN k ON floor(k.lx / pow(2, 4 - leaf.n)) = leaf.lx AND floor(k.ly / pow(2, 4 - leaf.n)) = leaf.ly AND floor(k.lz / pow(2, 4 - leaf.n)) = leaf.lz GROUP BY 1, 2, 3, 4")
def _(spark, sf_dir):
    return keys.end_node_of(cells(spark, sf_dir, 4), ragged(spark, sf_dir), WORLD3).groupBy("en", "ex", "ey", "ez").agg(F.count("*").alias("n_keys"))


@query("b11_end_nodes", f"""WITH {POINTS}, {RAGGED}, u AS (SELECT * FROM leaf UNION SELECT 1 AS n, CAST(floor(lx / 2.0) AS INT), CAST(floor(ly / 2.0) AS INT), CAST(floor(lz / 2.0) AS INT) FROM fine)
SELECT n, count(*) AS n_end FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.n = u.n + 1 AND floor(v.lx / 2.0) = u.lx AND floor(v.ly / 2.0) = u.ly AND floor(v.lz / 2.0) = u.lz) GROUP BY 1""")
def _(spark, sf_dir):
    nodes = ragged(spark, sf_dir).unionByName(cells(spark, sf_dir, 2).select(*keys.parent_key())).distinct()
    return keys.end_nodes(nodes, tree_key=False).groupBy("n").agg(F.count("*").alias("n_end"))


@query("b14_out_of_bounds", f"WITH {POINTS} SELECT (x < -1 OR x >= 2 OR y < -2 OR y >= 2) AS outside, count(*) AS n FROM pts GROUP BY 1")
def _(spark, sf_dir):
    return points(spark, sf_dir).groupBy(keys.out_of_bounds([-1.0, -2.0], [2.0, 2.0]).alias("outside")).agg(F.count("*").alias("n"))


# --- grids and transforms -------------------------------------------------------------------------------------------


@query("c1_build_uniform", f"WITH {POINTS}, {cells_sql(1)} SELECT 3 AS n, count(*) * 64 AS n_cells, CAST(sum(8 * (4 * lx + 1.5)) * 8 AS DOUBLE) AS sum_lx FROM cells")
def _(spark, sf_dir):
    g = grid.build_uniform(cells(spark, sf_dir, 1, "t"), MRA(WORLD3, 1), 2)
    return g.groupBy("n").agg(F.count("*").alias("n_cells"), F.sum("lx").cast("double").alias("sum_lx"))


SEES = "(c.n >= -floor(log2(3 / sqrt(2 * gs.a0))) AND c.n >= -floor(log2(3 / sqrt(2 * gs.a1))))"
AWAY = " OR ".join(f"gs.x{d} + 5 / sqrt(2 * gs.a{d}) < c.{a} * pow(2, -c.n) OR gs.x{d} - 5 / sqrt(2 * gs.a{d}) > (c.{a} + 1) * pow(2, -c.n)" for d, a in ((0, "lx"), (1, "ly")))


@query("c3_build_gaussian_grid", f"""WITH RECURSIVE {GAUSS.replace("AS DOUBLE) AS a", "AS DOUBLE) * 200 AS a")}, f AS (SELECT DISTINCT fn_id FROM gs), two AS (SELECT CAST(range AS INT) AS b FROM range(2)),
c AS (SELECT fn_id, -1 AS n, CAST(i.range AS INT) - 1 AS lx, CAST(j.range AS INT) - 1 AS ly FROM f, range(2) i, range(2) j
UNION SELECT c.fn_id, c.n + 1, 2 * c.lx + p.b, 2 * c.ly + q.b FROM c JOIN gs ON gs.fn_id = c.fn_id AND NOT {SEES} AND NOT ({AWAY}), two p, two q)
SELECT fn_id AS tree_id, n, count(*) AS n_cells FROM c GROUP BY 1, 2""")
def _(spark, sf_dir):
    """The grid that each sum of Gaussians calls for."""
    g = gaussians(spark, sf_dir).withColumn("alpha", F.transform("alpha", lambda a: a * 200))
    return grid.build_gaussian(g, MRA(WORLD2, 5, max_depth=12)).groupBy("tree_id", "n").agg(F.count("*").alias("n_cells"))


@query("c4_union_grid", f"WITH {POINTS}, {cells_sql(2, 'a')}, {cells_sql(3, 'b')}, u AS (SELECT * FROM a UNION SELECT n - 1, CAST(floor(lx / 2.0) AS INT), CAST(floor(ly / 2.0) AS INT), CAST(floor(lz / 2.0) AS INT) FROM b UNION SELECT * FROM b) SELECT n, count(*) AS n_cells FROM u GROUP BY 1")
def _(spark, sf_dir):
    fine = cells(spark, sf_dir, 3, "b")
    up = fine.select("tree_id", *keys.parent_key())
    return grid.union_grid([cells(spark, sf_dir, 2, "a"), fine, up], "u").groupBy("n").agg(F.count("*").alias("n_cells"))


@query("c4_extend_grid", f"""WITH {POINTS}, {RAGGED}, {cells_sql(2, 'b2')}, {cells_sql(3, 'b3')}, {cells_sql(4, 'b4')}, b AS (SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4),
k AS (SELECT n, lx, ly, lz FROM leaf UNION SELECT b.n, b.lx, b.ly, b.lz FROM b JOIN leaf ON b.n - leaf.n BETWEEN 1 AND 2 AND floor(b.lx / pow(2, b.n - leaf.n)) = leaf.lx AND floor(b.ly / pow(2, b.n - leaf.n)) = leaf.ly AND floor(b.lz / pow(2, b.n - leaf.n)) = leaf.lz) SELECT n, count(*) AS n_cells FROM k GROUP BY 1""")
def _(spark, sf_dir):
    """A ragged grid extended by finer ones, at most two scales below its leaves."""
    old = ragged(spark, sf_dir).withColumn("tree_id", F.lit("t")).select(*TREE_KEY)
    finer = cells(spark, sf_dir, 2, "t").unionByName(cells(spark, sf_dir, 3, "t")).unionByName(cells(spark, sf_dir, 4, "t"))
    return grid.extend_grid(old, finer, MRA(WORLD3, 1), 2).groupBy("n").agg(F.count("*").alias("n_cells"))


@query("c7_refine_uniform", f"WITH {haar_sql(by=SUPPLIER)} SELECT tree_id, round(sum(f) / {2**LEAF} + 3.7e-7, 4) AS integral, count(DISTINCT l // 2) * 2 AS n_end FROM leaf GROUP BY 1")
def _(spark, sf_dir):
    t = grid.refine_uniform(haar(spark, sf_dir, by=SUPPLIER), HAAR)
    ends = t.where("is_end").groupBy("tree_id").agg(F.count("*").alias("n_end"))
    return reduce.integrate(t, HAAR).join(ends, "tree_id").select("tree_id", F.round(F.col("integral") + 3.7e-7, 4).alias("integral"), "n_end")


def _scales_sql(by: str, what: str) -> str:
    """For each scale n < LEAF and cell: sums s (left child a, right child b) of the Haar functions."""
    return f"WITH {haar_sql(by=by)}, sc AS (SELECT CAST(range AS INT) AS n FROM range({LEAF})), h AS (SELECT tree_id, n, CAST(l // CAST(pow(2, {LEAF} - n) AS INT) AS INT) AS lx, sum(CASE WHEN l // CAST(pow(2, {LEAF} - 1 - n) AS INT) % 2 = 0 THEN f ELSE 0 END) AS a, sum(CASE WHEN l // CAST(pow(2, {LEAF} - 1 - n) AS INT) % 2 = 1 THEN f ELSE 0 END) AS b FROM leaf, sc GROUP BY 1, 2, 3) {what}"


def _crop_sql(prec: float) -> str:
    """The bottom-up rule, level by level: cut where a child is a leaf or cut and the own wavelet is small."""
    top = LEAF - 1
    steps, union = [], "SELECT tree_id, n, lx FROM h WHERE n = -1"
    for n in range(top - 1, -1, -1):
        below = f"SELECT tree_id, lx FROM h WHERE n = {top}" if n == top - 1 else f"SELECT tree_id, lx FROM cut{n + 1}"
        steps.append(f"cut{n} AS (SELECT j.tree_id, j.n, j.lx FROM j WHERE j.n = {n} AND j.small AND EXISTS (SELECT 1 FROM ({below}) b WHERE b.tree_id = j.tree_id AND b.lx // 2 = j.lx))")
        union += f" UNION ALL SELECT * FROM cut{n}"
    return _scales_sql(SUPPLIER, f""", t AS (SELECT tree_id, sqrt(sum(f * f) / {2**LEAF}) AS t FROM leaf GROUP BY 1),
j AS (SELECT h.tree_id, n, lx, abs(a - b) * pow(2, -{LEAF}) * pow(2, n / 2.0) <= greatest(2e-15, {prec} * t * pow(2, -0.5 * (n + 1))) AS small FROM h JOIN t ON h.tree_id = t.tree_id), {", ".join(steps)}, cut AS ({union}),
k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.tree_id = h.tree_id AND cut.n < h.n AND h.lx // CAST(pow(2, h.n - cut.n) AS INT) = cut.lx))
SELECT k.tree_id, count(*) AS n_nodes, CAST(sum(CASE WHEN k.n = {top} OR cut.n IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_end FROM k LEFT JOIN cut ON cut.tree_id = k.tree_id AND cut.n = k.n AND cut.lx = k.lx GROUP BY 1""")


@query("c11_crop", _crop_sql(0.3))
def _(spark, sf_dir):
    """Nodes left in each tree when small wavelets are pruned."""
    t = haar(spark, sf_dir, by=SUPPLIER)
    return grid.crop(t, HAAR, 0.3, abs_prec=False).groupBy("tree_id").agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_end").cast("int")).alias("n_end"))


@query("c8_refine_adaptive", _scales_sql(SUPPLIER, f", t AS (SELECT tree_id, sqrt(sum(f * f) / {2**LEAF}) AS t FROM leaf GROUP BY 1) SELECT h.tree_id, CAST(count(*) + sum(CASE WHEN abs(a - b) * pow(2, -{LEAF}) * pow(2, n / 2.0) > greatest(2e-15, 0.2 * t * pow(2, -0.5 * (n + 1))) THEN 1 ELSE 0 END) AS BIGINT) AS n_end FROM h JOIN t ON t.tree_id = h.tree_id WHERE n = {LEAF - 1} GROUP BY 1"))
def _(spark, sf_dir):
    """Leaves after one adaptive split step."""
    t, _new = grid.refine_adaptive(haar(spark, sf_dir, by=SUPPLIER), HAAR, 0.2)
    return t.where("is_end").groupBy("tree_id").agg(F.count("*").alias("n_end"))


@query("c9_refine_like", f"WITH {haar_sql(by=SUPPLIER)} SELECT tree_id, round(sum(f * f) / {2**LEAF} + 3.7e-5, 2) AS square_norm, count(DISTINCT l // 2) * 2 AS n_end FROM leaf GROUP BY 1")
def _(spark, sf_dir):
    """One step towards a finer tree; the function stays."""
    t = haar(spark, sf_dir, by=SUPPLIER)
    finer = grid.refine_like(t, write_shared(grid.refine_uniform(t, HAAR, 2)), HAAR)
    ends = finer.where("is_end").groupBy("tree_id").agg(F.count("*").alias("n_end"))
    return reduce.square_norm(finer).join(ends, "tree_id").select("tree_id", F.round(F.col("square_norm") + 3.7e-5, 2).alias("square_norm"), "n_end")


@query("c12_compress_plane", f"""WITH {PLANE_SQL}, sc AS (SELECT CAST(range AS INT) AS n FROM range({PLANE_LEAF})),
h AS (SELECT tree_id, n, lx // CAST(pow(2, {PLANE_LEAF} - n) AS INT) AS a, ly // CAST(pow(2, {PLANE_LEAF} - n) AS INT) AS b, sum(f * (lx + 0.5)) AS s FROM cell, sc GROUP BY 1, 2, 3, 4)
SELECT tree_id, n, count(*) AS n_nodes, round(sum(s) * pow(2, -{3 * PLANE_LEAF}) + 3.7e-7, 4) AS integral, round(sum(s * s) * pow(2, 2 * n) * pow(2, -{6 * PLANE_LEAF}) + 3.7e-7, 4) AS mean_square FROM h GROUP BY 1, 2""")
def _(spark, sf_dir):
    """By scale: nodes, and the sum and square sum of their means, of order-1 trees in two dimensions."""
    t = plane(spark, sf_dir)
    mean = F.col("coef")[0]
    return t.groupBy("tree_id", "n").agg(F.count("*").alias("n_nodes"), F.round(F.sum(mean * F.pow(F.lit(2.0), -F.col("n"))) + 3.7e-7, 4).alias("integral"), F.round(F.sum(mean * mean) + 3.7e-7, 4).alias("mean_square"))


@query("c13_reconstruct_plane", f"""WITH {PLANE_SQL} SELECT tree_id, count(DISTINCT lx // 2 * 1000 + ly // 2) AS n_end, round(sum(f * f * (pow(lx + 1, 3) - pow(lx, 3)) / 3) * pow(2, -{4 * PLANE_LEAF}) + 3.7e-7, 4) AS square_norm, round(sum(f * (lx + 0.5)) * pow(2, -{3 * PLANE_LEAF}) + 3.7e-7, 4) AS integral FROM cell GROUP BY 1""")
def _(spark, sf_dir):
    """The leaves' norms and integrals after all scaling blocks below the roots were dropped and rebuilt from the wavelets."""
    t = plane(spark, sf_dir)
    dropped = F.when(F.col("n") == 0, F.col("coef")).otherwise(F.transform("coef", lambda x, i: F.when(i < PLANE.size, 0.0).otherwise(x)))
    ends = transform.reconstruct_down(t.select(*TREE_KEY, "is_end", dropped.alias("coef")), PLANE).where("is_end")
    return ends.groupBy("tree_id").agg(F.count("*").alias("n_end"), F.round(F.sum("sq_norm") + 3.7e-7, 4).alias("square_norm"), F.round(F.sum(F.col("coef")[0] * F.pow(F.lit(2.0), -F.col("n"))) + 3.7e-7, 4).alias("integral"))


@query("c12_compress_up", _scales_sql(SUPPLIER, f"SELECT tree_id, n, lx, round((a + b) * pow(2, -{LEAF}) * pow(2, n / 2.0) + 3.7e-7, 4) AS s, round(pow((a - b) * pow(2, -{LEAF}) * pow(2, n / 2.0), 2) + 3.7e-6, 3) AS w2 FROM h"))
def _(spark, sf_dir):
    """Scaling coefficients and squared wavelet coefficients of all nodes."""
    t = haar(spark, sf_dir, by=SUPPLIER)
    return t.select("tree_id", "n", "lx", F.round(F.col("coef")[0] + 3.7e-7, 4).alias("s"), F.round(F.pow(F.col("coef")[1], 2) + 3.7e-6, 3).alias("w2"))


@query("c13_reconstruct_down", _scales_sql(SUPPLIER, f"SELECT tree_id, n, lx, round((a + b) * pow(2, -{LEAF}) * pow(2, n / 2.0) + 3.7e-7, 4) AS s FROM h"))
def _(spark, sf_dir):
    """Scaling coefficients of all nodes, rebuilt from the wavelets and the roots alone."""
    t = haar(spark, sf_dir, by=SUPPLIER)
    dropped = F.when(F.col("n") == 0, F.col("coef")).otherwise(F.array(F.lit(0.0), F.col("coef")[1]))
    r = transform.reconstruct_down(t.select(*TREE_KEY, "is_end", dropped.alias("coef")), HAAR)
    return r.select("tree_id", "n", "lx", F.round(F.col("coef")[0] + 3.7e-7, 4).alias("s"))


@query("c14_push_down", f"WITH {haar_sql(by=SUPPLIER)}, p AS (SELECT DISTINCT tree_id, l // 2 AS p FROM leaf), g AS (SELECT tree_id, CAST(4 * p + range AS INT) AS lx FROM p, range(4)) SELECT g.tree_id, g.lx, round(coalesce(f, 0) * pow(2, -{LEAF + 1} / 2.0) + 3.7e-7, 4) AS s FROM g LEFT JOIN leaf ON leaf.tree_id = g.tree_id AND leaf.l = g.lx // 2")
def _(spark, sf_dir):
    """Values on cells two levels below the leaves."""
    t = haar(spark, sf_dir, by=SUPPLIER).where("is_end")
    cells_ = keys.children(t.select(*TREE_KEY), 1, 2).select(*TREE_KEY)
    return transform.push_down(t, cells_, HAAR).select("tree_id", "lx", F.abs(F.round(F.col("coef")[0] + 3.7e-7, 4)).alias("s"))


@query("c18_max_norms", _scales_sql(SUPPLIER, f"SELECT h.tree_id, h.n, h.lx, round(max((c.a * c.a + c.b * c.b) * 2 * pow(2, 2 * c.n) * pow(2, -{2 * LEAF})) + 3.7e-5, 2) AS max_sq FROM h JOIN h c ON c.tree_id = h.tree_id AND c.n >= h.n AND c.lx // CAST(pow(2, c.n - h.n) AS INT) = h.lx GROUP BY 1, 2, 3"))
def _(spark, sf_dir):
    return transform.max_norms(haar(spark, sf_dir, by=SUPPLIER), HAAR).select("tree_id", "n", "lx", F.round(F.col("max_sq") + 3.7e-5, 2).alias("max_sq"))


# --- projection -----------------------------------------------------------------------------------------------------


NORM_1D = "sum(a.coef * b.coef * sqrt(pi() / (a.a0 + b.a0)) * exp(-a.a0 * b.a0 / (a.a0 + b.a0) * (a.x0 - b.x0) * (a.x0 - b.x0)))"
LINE = MRA(World(1, -4, (-1,), (2,)), 7)


@query("d2_project_gaussians", f"WITH {GAUSS}, i AS (SELECT fn_id, sum(coef * sqrt(pi() / a0)) AS i FROM gs GROUP BY 1), q AS (SELECT a.fn_id, {NORM_1D} AS q FROM gs a JOIN gs b ON a.fn_id = b.fn_id GROUP BY 1) SELECT i.fn_id AS tree_id, round(i / sqrt(q) + 3.7e-5, 3) AS integral, round(sqrt(q) + 3.7e-5, 3) AS norm FROM i JOIN q ON i.fn_id = q.fn_id")
def _(spark, sf_dir):
    """All Gaussian sums projected at once: their norms, and their integrals in units of these."""
    t = write_shared(project.project_gaussians(gaussians(spark, sf_dir, dim=1), LINE, 1e-6))
    j = reduce.integrate(t, LINE).join(reduce.square_norm(t), "tree_id")
    return j.select("tree_id", F.round(F.col("integral") / F.sqrt("square_norm") + 3.7e-5, 3).alias("integral"), F.round(F.sqrt("square_norm") + 3.7e-5, 3).alias("norm"))


@query("a4_text_round_trip", ORACLES["d2_project_gaussians"])
def _(spark, sf_dir):
    """The projected functions written as text, several files a tree, and read again."""
    t = project.project_gaussians(gaussians(spark, sf_dir, dim=1), LINE, 1e-6)
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    trees.export_leaf_text(t, LINE, path, cells_a_file=40)
    back = write_shared(trees.import_leaf_text(spark, path, LINE))
    j = reduce.integrate(back, LINE).join(reduce.square_norm(back), "tree_id")
    return j.select("tree_id", F.round(F.col("integral") / F.sqrt("square_norm") + 3.7e-5, 3).alias("integral"), F.round(F.sqrt("square_norm") + 3.7e-5, 3).alias("norm"))


# --- arithmetic -----------------------------------------------------------------------------------------------------


@query("e1_add", f"WITH {haar_sql()} SELECT 'sum' AS tree_id, round(sum(CASE tree_id WHEN 'A' THEN 2 * f WHEN 'N' THEN -f ELSE 0.5 * f END) / {2**LEAF} + 3.7e-7, 4) AS integral FROM leaf")
def _(spark, sf_dir):
    t = haar(spark, sf_dir)
    terms = t.select("tree_id").distinct().select(F.lit("sum").alias("out_id"), "tree_id", F.when(F.col("tree_id") == "A", 2.0).when(F.col("tree_id") == "N", -1.0).otherwise(0.5).alias("c"))
    return reduce.integrate(arith.add(terms, t, HAAR), HAAR).select("tree_id", F.round(F.col("integral") + 3.7e-7, 4).alias("integral"))


@query("e5_multiply", f"WITH {haar_sql()} SELECT a.tree_id || b.tree_id AS tree_id, round(sum(a.f * b.f) / {2**LEAF} + 3.7e-5, 2) AS integral FROM leaf a JOIN leaf b ON a.l = b.l AND a.tree_id <= b.tree_id GROUP BY 1")
def _(spark, sf_dir):
    """Pointwise products of all pairs of functions."""
    t = haar(spark, sf_dir)
    ids = t.select("tree_id").distinct()
    terms = ids.select(F.col("tree_id").alias("a_id"), F.lit(1).alias("one")).join(ids.select(F.col("tree_id").alias("b_id"), F.lit(1).alias("one")), "one").where("a_id <= b_id")
    out = arith.multiply(terms.select(F.concat("a_id", "b_id").alias("out_id"), "a_id", "b_id", F.lit(1.0).alias("c")), t, HAAR)
    return reduce.integrate(out, HAAR).select("tree_id", F.round(F.col("integral") + 3.7e-5, 2).alias("integral"))


@query("e5_multiply_many", f"WITH {haar_sql(by=SUPPLIER)}, {haar_sql('l_linenumber', 'other', SUPPLIER)} SELECT leaf.tree_id, round(sum(0.5 * f * f * g) / {2**LEAF} / 100 + 3.7e-5, 2) AS integral FROM leaf JOIN (SELECT tree_id, l, f AS g FROM other) o ON o.tree_id = leaf.tree_id AND o.l = leaf.l GROUP BY 1")
def _(spark, sf_dir):
    """Products of three factors for each supplier: its quantities twice and its line numbers."""
    f, g = (t.withColumn("tree_id", F.concat("tree_id", F.lit(x))) for t, x in zip(_pair(spark, sf_dir), "fg", strict=True))
    t = f.unionByName(g)
    ids = f.select(F.regexp_replace("tree_id", "f$", "").alias("out_id")).distinct()
    terms = ids.select("out_id", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(c).alias("c")) for x, c in (("f", 0.25), ("f", 1.0), ("g", 2.0))])).alias("p"))
    out = arith.multiply_many(terms.select("out_id", F.concat("out_id", "p.x").alias("tree_id"), "p.c"), t, HAAR)
    return reduce.integrate(out, HAAR).select("tree_id", F.round(F.col("integral") / 100 + 3.7e-5, 2).alias("integral"))


@query("e18_hinted_product", f"WITH {haar_sql(by=SUPPLIER)}, i AS (SELECT range AS i FROM range(8)), v AS (SELECT tree_id, l, f * avg(CASE WHEN (l + (i + 0.5) / 8) / {2**LEAF} < 0.3 THEN 1 ELSE 0.25 END) AS v FROM leaf, i GROUP BY tree_id, l, f) SELECT tree_id, round(sum(v) / {2**LEAF} + 3.7e-7, 4) AS integral, CAST(count(DISTINCT l // 2) + 3 * max(CASE WHEN l // 2 = 9 THEN 1 ELSE 0 END) AS BIGINT) AS n_end FROM v GROUP BY 1")
def _(spark, sf_dir):
    """Every tree times a step at 0.3: only the cell that holds the step is split, three times; coarse values of the step come from its own tree."""
    f = lambda x: np.where(x[:, 0] < 0.3, 1.0, 0.25)
    wants = lambda n, low, high: (low[:, 0] < 0.3) & (high[:, 0] > 0.3)
    grid_ = spark.range(2 ** (LEAF - 1)).select(F.lit("f").alias("tree_id"), F.lit(LEAF - 1).alias("n"), F.col("id").cast("int").alias("lx"), F.lit(0).alias("ly"), F.lit(0).alias("lz"))
    step = write_shared(project.project_function(spark, HAAR, f, -1.0, start=grid_))
    out = write_shared(arith.multiply_by_function(haar(spark, sf_dir, by=SUPPLIER), HAAR, f, refine=3, wants=wants, of_f=step))
    ends = out.where("is_end").groupBy("tree_id").agg(F.count("*").alias("n_end"))
    return _integral(out).join(ends, "tree_id")


@query("e10_tree_map", f"WITH {haar_sql(by=SUPPLIER)} SELECT tree_id, round(sum(sqrt(f + 1) - 1) / {2**LEAF}, 4) AS integral FROM leaf GROUP BY 1")
def _(spark, sf_dir):
    """A user's function of the values, pointwise."""
    out = arith.tree_map(haar(spark, sf_dir, by=SUPPLIER), HAAR, lambda v: np.sqrt(np.maximum(v, 0) + 1) - 1)
    return reduce.integrate(out, HAAR).select("tree_id", F.round("integral", 4).alias("integral"))


@query("e12_normalize", f"WITH {haar_sql(by=SUPPLIER)} SELECT tree_id, round(sum(f) / {2**LEAF} / sqrt(sum(f * f) / {2**LEAF}), 6) AS integral FROM leaf GROUP BY 1")
def _(spark, sf_dir):
    return reduce.integrate(arith.normalize(haar(spark, sf_dir, by=SUPPLIER), HAAR), HAAR).select("tree_id", F.round("integral", 6).alias("integral"))


@query("e20_leaf_values", f"WITH {haar_sql(by=SUPPLIER)}, g AS (SELECT tree_id, l // 2 AS lx, sum(CASE WHEN l % 2 = 0 THEN f ELSE 0 END) AS v0, sum(CASE WHEN l % 2 = 1 THEN f ELSE 0 END) AS v1 FROM leaf GROUP BY 1, 2) SELECT tree_id, CAST(lx AS INT) AS lx, round(v0 + 3.7e-7, 4) AS v0, round(v1 + 3.7e-7, 4) AS v1 FROM g")
def _(spark, sf_dir):
    v = transform.leaf_values(haar(spark, sf_dir, by=SUPPLIER).where("is_end"), HAAR)
    return v.select("tree_id", "lx", F.abs(F.round(F.col("values")[0] + 3.7e-7, 4)).alias("v0"), F.abs(F.round(F.col("values")[1] + 3.7e-7, 4)).alias("v1"))


def _integral(t: DataFrame, digits: int = 4) -> DataFrame:
    return reduce.integrate(t, HAAR).select("tree_id", F.round(F.col("integral") + 3.7 * 10.0 ** (-digits - 3), digits).alias("integral"))


def _both_sql(what: str, digits: int = 4) -> str:
    """An integral over cells of f, the supplier's quantities, and g, its line numbers."""
    return f"WITH {haar_sql(by=SUPPLIER)}, {haar_sql('l_linenumber', 'other', SUPPLIER)} SELECT leaf.tree_id, round(sum({what}) / {2**LEAF} + {3.7 * 10.0 ** (-digits - 3)}, {digits}) AS integral FROM (SELECT tree_id, l, f FROM leaf) leaf JOIN (SELECT tree_id, l, f AS g FROM other) o ON o.tree_id = leaf.tree_id AND o.l = leaf.l GROUP BY 1"


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trees of each supplier's quantities and of its line numbers; lineitem is read once."""
    both = ["l_quantity", "l_linenumber"]
    sums = write_shared(_haar_sums(spark, sf_dir, both, SUPPLIER))
    f, g = (_haar_nodes(_haar_block(sums, value, SUPPLIER), written=True) for value in both)
    return f, g


@query("e2_add_fixed", _both_sql("f + 2 * g"))
def _(spark, sf_dir):
    t, x = _pair(spark, sf_dir)
    return _integral(arith.add_in_place_fixed(t, x, HAAR, 2.0))


@query("e3_add_in_place", _both_sql("f - 0.5 * g"))
def _(spark, sf_dir):
    t, x = _pair(spark, sf_dir)
    return _integral(arith.add_in_place(t, x, HAAR, -0.5))


@query("e4_absadd", _both_sql("f * f + 9 * g * g", 2))
def _(spark, sf_dir):
    t, x = _pair(spark, sf_dir)
    return _integral(arith.absadd(t, x, HAAR, 3.0), 2)


@query("e7_multiply_in_place", _both_sql("0.5 * f * g", 2))
def _(spark, sf_dir):
    t, x = _pair(spark, sf_dir)
    return _integral(arith.multiply_in_place(t, x, HAAR, 0.5), 2)


@query("e6_multiply_max_norm", f"WITH {haar_sql()} SELECT a.tree_id || b.tree_id AS tree_id, round(sum(a.f * b.f) / {2**LEAF} + 3.7e-5, 2) AS integral FROM leaf a JOIN leaf b ON a.l = b.l AND a.tree_id <= b.tree_id GROUP BY 1")
def _(spark, sf_dir):
    """Products on the grid that norms call for; at precision 0 that is the union grid."""
    t = haar(spark, sf_dir)
    ids = t.select("tree_id").distinct()
    terms = ids.select(F.col("tree_id").alias("a_id")).join(F.broadcast(ids.select(F.col("tree_id").alias("b_id")))).where("a_id <= b_id")
    return _integral(arith.multiply_max_norm(terms.select(F.concat("a_id", "b_id").alias("out_id"), "a_id", "b_id", F.lit(1.0).alias("c")), t, HAAR, 0.0), 2)


@query("e8_square", f"WITH {haar_sql(by=SUPPLIER)} SELECT tree_id, round(sum(f * f) / {2**LEAF} + 3.7e-5, 2) AS integral FROM leaf GROUP BY 1")
def _(spark, sf_dir):
    return _integral(arith.square(haar(spark, sf_dir, by=SUPPLIER), HAAR, extra=0), 2)


@query("e9_power", f"WITH {haar_sql('l_discount', by=SUPPLIER)} SELECT tree_id, round(sum(pow(f, 3)) / {2**LEAF} + 3.7e-9, 6) AS integral FROM leaf GROUP BY 1")
def _(spark, sf_dir):
    return reduce.integrate(arith.power(haar(spark, sf_dir, "l_discount", SUPPLIER), HAAR, 3, extra=0), HAAR).select("tree_id", F.round(F.col("integral") + 3.7e-9, 6).alias("integral"))


@query("e11_rescale", f"WITH {haar_sql(by=SUPPLIER)} SELECT tree_id, round(sum(-1.5 * f) / {2**LEAF} + 3.7e-7, 4) AS integral FROM leaf GROUP BY 1")
def _(spark, sf_dir):
    return _integral(arith.rescale(haar(spark, sf_dir, by=SUPPLIER), -1.5, HAAR))


@query("e13_dot_field", f"WITH {haar_sql()} SELECT 'field' AS tree_id, round(sum(CASE WHEN a.tree_id = 'A' AND b.tree_id = 'N' THEN 2 * a.f * b.f WHEN a.tree_id = 'N' AND b.tree_id = 'R' THEN -a.f * b.f ELSE 0 END) / {2**LEAF} + 3.7e-5, 2) AS integral FROM leaf a JOIN leaf b ON a.l = b.l")
def _(spark, sf_dir):
    pairs = spark.createDataFrame([("field", 0, "A", "N", 2.0), ("field", 1, "N", "R", -1.0)], "out_id string, d int, a_id string, b_id string, c double")
    return _integral(arith.dot_field(pairs, haar(spark, sf_dir), HAAR), 2)


@query("e18_multiply_by_function", f"WITH {haar_sql(by=SUPPLIER)} SELECT tree_id, round(sum(f * (l + 0.5) / {2**LEAF}.0) / {2**LEAF} + 3.7e-7, 4) AS integral FROM leaf GROUP BY 1")
def _(spark, sf_dir):
    """Every tree times x, which is evaluated once for each cell that any tree has."""
    return _integral(arith.multiply_by_function(haar(spark, sf_dir, by=SUPPLIER), HAAR, lambda x: x[:, 0]))


def _complex(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """F = A + i N with two components, G = R with one, over the trees of return flags."""
    f = components.function(spark, "F", {0: ("A", "N"), 1: ("N", None)}).unionByName(components.function(spark, "G", {0: ("R", None)}))
    return f, haar(spark, sf_dir)


@query("e14_linear_combination", f"WITH {haar_sql()}, s AS (SELECT sum(CASE tree_id WHEN 'A' THEN f END) / {2**LEAF} AS a, sum(CASE tree_id WHEN 'N' THEN f END) / {2**LEAF} AS n, sum(CASE tree_id WHEN 'R' THEN f END) / {2**LEAF} AS r FROM leaf) SELECT 'S/0/re' AS tree_id, round(-2 * n + r + 3.7e-7, 4) AS integral FROM s UNION ALL SELECT 'S/0/im', round(2 * a + 3.7e-7, 4) FROM s UNION ALL SELECT 'S/1/im', round(2 * n + 3.7e-7, 4) FROM s")
def _(spark, sf_dir):
    """2i F + G."""
    f, t = _complex(spark, sf_dir)
    terms = spark.createDataFrame([("S", "F", 0.0, 2.0), ("S", "G", 1.0, 0.0)], "out_id string, fn_id string, c_re double, c_im double")
    return _integral(components.linear_combination(terms, f, t, HAAR)[1])


@query("e16_complex_multiply", f"WITH {haar_sql()}, s AS (SELECT sum(x.f * r.f) / {2**LEAF} AS v, x.tree_id FROM leaf x JOIN leaf r ON r.l = x.l AND r.tree_id = 'R' GROUP BY 2) SELECT CASE tree_id WHEN 'A' THEN 'P/0/re' ELSE 'P/0/im' END AS tree_id, round(v + 3.7e-5, 2) AS integral FROM s WHERE tree_id IN ('A', 'N')")
def _(spark, sf_dir):
    f, t = _complex(spark, sf_dir)
    pairs = spark.createDataFrame([("P", "F", "G")], "out_id string, a_id string, b_id string")
    return _integral(components.multiply(pairs, f, t, HAAR)[1], 2)


@query("e17_density", f"WITH {haar_sql()}, s AS (SELECT tree_id, sum(f * f) / {2**LEAF} AS v FROM leaf GROUP BY 1) SELECT 'F/0/re' AS tree_id, round((SELECT sum(v) FROM s WHERE tree_id IN ('A', 'N')) + 3.7e-5, 2) AS integral UNION ALL SELECT 'F/1/re', round((SELECT v FROM s WHERE tree_id = 'N') + 3.7e-5, 2) UNION ALL SELECT 'G/0/re', round((SELECT v FROM s WHERE tree_id = 'R') + 3.7e-5, 2)")
def _(spark, sf_dir):
    f, t = _complex(spark, sf_dir)
    return _integral(components.density(f, t, HAAR)[1], 2)


# --- reductions -----------------------------------------------------------------------------------------------------


@query("f1_integrate", f"WITH {haar_sql(by=SUPPLIER)} SELECT tree_id, round(sum(f) / {2**LEAF} + 3.7e-7, 4) AS integral FROM leaf GROUP BY 1")
def _(spark, sf_dir):
    return reduce.integrate(haar(spark, sf_dir, by=SUPPLIER), HAAR).select("tree_id", F.round(F.col("integral") + 3.7e-7, 4).alias("integral"))


@query("f3_integrate_end_nodes", f"WITH {haar_sql(by=SUPPLIER)}, c AS (SELECT DISTINCT tree_id, l // 2 AS c FROM leaf) SELECT tree_id, round(sum((pow((c + 1) / {2 ** (LEAF - 1)}.0, 2) - pow(c / {2 ** (LEAF - 1)}.0, 2)) / 2), 6) AS integral FROM c GROUP BY 1")
def _(spark, sf_dir):
    """The integral of x over the cells of each tree's leaf grid."""
    return reduce.integrate_end_nodes(haar(spark, sf_dir, by=SUPPLIER), HAAR, lambda x: x[:, 0]).select("tree_id", F.round("integral", 6).alias("integral"))


@query("f4_square_norm", f"WITH {haar_sql(by=SUPPLIER)} SELECT tree_id, round(sum(f * f) / {2**LEAF} + 3.7e-5, 2) AS square_norm FROM leaf GROUP BY 1")
def _(spark, sf_dir):
    return reduce.square_norm(haar(spark, sf_dir, by=SUPPLIER)).select("tree_id", F.round(F.col("square_norm") + 3.7e-5, 2).alias("square_norm"))


@query("f5_dot", f"WITH {haar_sql()}, {haar_sql('l_linenumber', 'ket')} SELECT leaf.tree_id AS bra_id, ket.tree_id AS ket_id, round(sum(leaf.f * ket.f) / {2**LEAF} + 3.7e-5, 2) AS dot FROM leaf JOIN ket ON leaf.l = ket.l GROUP BY 1, 2")
def _(spark, sf_dir):
    bra, ket = haar(spark, sf_dir), haar(spark, sf_dir, "l_linenumber")
    out = linalg.cross_overlap(bra, ket, HAAR)
    return out.select(F.col("i").alias("bra_id"), F.col("j").alias("ket_id"), F.round(F.col("re") + 3.7e-5, 2).alias("dot"))


@query("f9_evaluate", f"WITH {haar_sql()} SELECT l_returnflag AS tree_id, count(*) AS n_points, round(sum(f) + 3.7e-5, 2) AS total FROM lineitem LEFT JOIN leaf ON leaf.tree_id = l_returnflag AND leaf.l = l_suppkey % {2**LEAF} GROUP BY 1")
def _(spark, sf_dir):
    """Every line item's function at the middle of a cell that its supplier names."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pid = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    p = t.select(pid.alias("pid"), F.col("l_returnflag").alias("tree_id"), ((F.col("l_suppkey") % 2**LEAF + 0.5) / 2**LEAF).alias("x")).groupBy("pid", "tree_id", "x").agg(F.count("*").alias("m"))
    v = reduce.evaluate(p, haar(spark, sf_dir), HAAR, precise=True)
    return p.join(v, ["pid", "tree_id"]).groupBy("tree_id").agg(F.sum("m").alias("n_points"), F.round(F.sum(F.col("m") * F.col("value")) + 3.7e-5, 2).alias("total"))


@query("f13_tree_stats", _scales_sql(SUPPLIER, "SELECT tree_id, n, count(*) AS n_nodes FROM h GROUP BY ROLLUP (tree_id, n)"))
def _(spark, sf_dir):
    return reduce.tree_stats(haar(spark, sf_dir, by=SUPPLIER)).select("tree_id", "n", "n_nodes")


@query("f6_component_dot", f"WITH {haar_sql()}, s AS (SELECT a.tree_id AS i, b.tree_id AS j, sum(a.f * b.f) / {2**LEAF} AS s FROM leaf a JOIN leaf b ON a.l = b.l GROUP BY 1, 2) SELECT 'F' AS a_id, 'G' AS b_id, round((SELECT s FROM s WHERE i = 'A' AND j = 'R') + 3.7e-5, 2) AS re, round(-(SELECT s FROM s WHERE i = 'N' AND j = 'R') + 3.7e-5, 2) AS im UNION ALL SELECT 'F', 'F', round((SELECT sum(CASE i WHEN 'A' THEN s WHEN 'N' THEN 2 * s END) FROM s WHERE i = j) + 3.7e-5, 2), CAST(0 AS DOUBLE)")
def _(spark, sf_dir):
    f, t = _complex(spark, sf_dir)
    pairs = spark.createDataFrame([("F", "G"), ("F", "F")], "a_id string, b_id string")
    return components.dot(pairs, f, t, HAAR).select("a_id", "b_id", F.round(F.col("re") + 3.7e-5, 2).alias("re"), F.round(F.col("im") + 3.7e-5, 2).alias("im"))


@query("f7_node_norm_dot", f"WITH {haar_sql(by=SUPPLIER)}, {haar_sql('l_linenumber', 'other', SUPPLIER)}, a AS (SELECT tree_id, l // 2 AS c, sqrt(sum(f * f)) AS v FROM leaf GROUP BY 1, 2), b AS (SELECT tree_id, l // 2 AS c, sqrt(sum(f * f)) AS v FROM other GROUP BY 1, 2) SELECT a.tree_id AS bra_id, round(sum(a.v * b.v) / {2**LEAF} + 3.7e-5, 2) AS bound FROM a JOIN b ON a.tree_id = b.tree_id AND a.c = b.c GROUP BY 1")
def _(spark, sf_dir):
    t, x = _pair(spark, sf_dir)
    pairs = t.select(F.col("tree_id").alias("bra_id"), F.col("tree_id").alias("ket_id")).distinct()
    return reduce.node_norm_dot(pairs, t, x, HAAR).select("bra_id", F.round(F.col("bound") + 3.7e-5, 2).alias("bound"))


@query("f8_node_norm_dot_exact", f"""WITH {haar_sql("l_discount", by=SUPPLIER)}, {haar_sql("l_tax", "other", SUPPLIER)}, pair AS (SELECT tree_id, l // 2 AS c, sum(CASE WHEN l % 2 = 0 THEN f * f ELSE 0 END) AS p, sum(CASE WHEN l % 2 = 1 THEN f * f ELSE 0 END) AS q FROM leaf GROUP BY 1, 2),
pair2 AS (SELECT tree_id, l // 2 AS c, sum(CASE WHEN l % 2 = 0 THEN f * f ELSE 0 END) AS p, sum(CASE WHEN l % 2 = 1 THEN f * f ELSE 0 END) AS q FROM other GROUP BY 1, 2)
SELECT a.tree_id AS bra_id, round(1e6 * sum(pow((a.p + a.q) * (b.p + b.q) / 2, 2) + pow((a.p - a.q) * (b.p - b.q) / 2, 2)) * pow(2, -{2 * LEAF}), 5) AS bound FROM pair a JOIN pair2 b ON a.tree_id = b.tree_id AND a.c = b.c GROUP BY 1""")
def _(spark, sf_dir):
    t, x = haar(spark, sf_dir, "l_discount", SUPPLIER), haar(spark, sf_dir, "l_tax", SUPPLIER)
    pairs = t.select(F.col("tree_id").alias("bra_id"), F.col("tree_id").alias("ket_id")).distinct()
    return reduce.node_norm_dot_exact(pairs, t, x, HAAR).select("bra_id", F.round(1e6 * F.col("bound"), 5).alias("bound"))


@query("f11_sample_line", f"WITH {haar_sql(by=SUPPLIER)}, g AS (SELECT tree_id, l // 2 AS c, sum(f) / 2 AS v FROM leaf GROUP BY 1, 2), t AS (SELECT DISTINCT tree_id FROM leaf), p AS (SELECT tree_id, range AS pid FROM t, range(41)) SELECT p.tree_id, p.pid, round(coalesce(v, 0) + 3.7e-7, 4) AS value FROM p LEFT JOIN g ON g.tree_id = p.tree_id AND g.c = CAST(floor((0.01 + p.pid * 0.025) * {2 ** (LEAF - 1)}) AS INT)")
def _(spark, sf_dir):
    """The scaling part of every tree at 41 points of a line, the last beyond the world."""
    t = haar(spark, sf_dir, by=SUPPLIER)
    line = spark.range(41).select(F.col("id").alias("pid"), (0.01 + F.col("id") * 0.025).alias("x"))
    p = t.select("tree_id").distinct().join(F.broadcast(line))
    return reduce.evaluate(p, t, HAAR).select("tree_id", "pid", F.round(F.col("value") + 3.7e-7, 4).alias("value"))


@query("f12_grid_cells", f"WITH {haar_sql(by=SUPPLIER)}, c AS (SELECT DISTINCT tree_id, l // 2 AS c FROM leaf) SELECT tree_id, count(*) + 1 AS n_cells, round(sum((c + 1) / {2 ** (LEAF - 1)}.0) + 1, 6) AS sum_hi FROM c GROUP BY 1")
def _(spark, sf_dir):
    return reduce.grid_cells(haar(spark, sf_dir, by=SUPPLIER), WORLD1).groupBy("tree_id").agg(F.count("*").alias("n_cells"), F.round(F.sum("hi_x"), 6).alias("sum_hi"))


# --- linear algebra -------------------------------------------------------------------------------------------------


@query("g2_overlap_matrix", f"WITH {haar_sql()} SELECT a.tree_id AS i, b.tree_id AS j, round(sum(a.f * b.f) / {2**LEAF} + 3.7e-5, 2) AS re FROM leaf a JOIN leaf b ON a.l = b.l GROUP BY 1, 2")
def _(spark, sf_dir):
    return linalg.overlap_matrix(haar(spark, sf_dir), HAAR).select("i", "j", F.round(F.col("re") + 3.7e-5, 2).alias("re"))


@query("g8_orthonormalize", f"WITH {haar_sql()} SELECT a.tree_id AS i, b.tree_id AS j, round(sum(a.f * b.f) / {2**LEAF} + 3.7e-5, 2) AS re FROM leaf a JOIN leaf b ON a.l = b.l GROUP BY 1, 2")
def _(spark, sf_dir):
    """The functions' overlaps again, from their components along the Loewdin-rotated set: it is orthonormal and spans the same functions."""
    t = haar(spark, sf_dir)
    along = write_shared(linalg.cross_overlap(t, write_shared(linalg.orthonormalize(t, HAAR)), HAAR))
    other = along.select(F.col("i").alias("b"), F.col("j"), F.col("re").alias("rb"))
    return along.join(other, "j").groupBy("i", F.col("b").alias("j")).agg(F.round(F.sum(F.col("re") * F.col("rb")) + 3.7e-5, 2).alias("re"))


@query("g5_rotate", f"WITH {haar_sql()}, u AS (SELECT * FROM (VALUES ('A', 'x', 1.0), ('N', 'x', -0.5), ('R', 'y', 2.0), ('A', 'y', 0.25)) v(i, j, u)), o AS (SELECT j, l, sum(u * f) AS f FROM leaf JOIN u ON u.i = leaf.tree_id GROUP BY 1, 2) SELECT j AS tree_id, round(sum(f) / {2**LEAF} + 3.7e-7, 4) AS integral, round(sum(f * f) / {2**LEAF} + 3.7e-5, 2) AS square_norm FROM o GROUP BY 1")
def _(spark, sf_dir):
    """Three functions to two, cut where wavelets vanish."""
    u = spark.createDataFrame([("A", "x", 1.0), ("N", "x", -0.5), ("R", "y", 2.0), ("A", "y", 0.25)], "i string, j string, re double")
    t = write_shared(linalg.rotate(haar(spark, sf_dir), u, HAAR, 1e-9))
    return reduce.integrate(t, HAAR).join(reduce.square_norm(t), "tree_id").select("tree_id", F.round(F.col("integral") + 3.7e-7, 4).alias("integral"), F.round(F.col("square_norm") + 3.7e-5, 2).alias("square_norm"))


@query("g7_orthogonalize", f"WITH {haar_sql()}, s AS (SELECT a.tree_id AS i, b.tree_id AS j, sum(a.f * b.f) / {2**LEAF} AS s FROM leaf a JOIN leaf b ON a.l = b.l GROUP BY 1, 2) SELECT b.i AS tree_id, round((b.s - x.s * x.s / k.s) + 3.7e-5, 2) AS square_norm FROM s b JOIN s x ON x.i = b.i AND x.j = 'N' JOIN s k ON k.i = 'N' AND k.j = 'N' WHERE b.i = b.j AND b.i <> 'N'")
def _(spark, sf_dir):
    """What is left of the functions without their component along one of them."""
    t = haar(spark, sf_dir)
    rest = linalg.orthogonalize(t.where("tree_id <> 'N'"), t.where("tree_id = 'N'"), HAAR)
    return reduce.square_norm(rest).select("tree_id", F.round(F.col("square_norm") + 3.7e-5, 2).alias("square_norm"))


# --- derivatives ----------------------------------------------------------------------------------------------------


# the norm of the derivative, from the overlaps of x exp(-a x^2) terms in closed form
SLOPE = """WITH {gauss} SELECT a.fn_id AS tree_id, round(0.5 * ln(sum(a.coef * b.coef * sqrt(pi() / (a.a0 + b.a0)) * exp(-a.a0 * b.a0 / (a.a0 + b.a0) * (a.x0 - b.x0) * (a.x0 - b.x0))
  * 2 * a.a0 * b.a0 / (a.a0 + b.a0) * (1 - 2 * a.a0 * b.a0 / (a.a0 + b.a0) * (a.x0 - b.x0) * (a.x0 - b.x0)))) + 3.7e-4, 2) AS log_norm FROM gs a JOIN gs b ON a.fn_id = b.fn_id GROUP BY 1"""


def _slope(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = write_shared(project.project_gaussians(gaussians(spark, sf_dir, dim=1), LINE, 1e-6))
        d = {"weak": derivative.apply, "low_noise": derivative.low_noise, "spline": derivative.spline}[kind](t, LINE, 0)
        return reduce.square_norm(d).select("tree_id", F.round(0.5 * F.log("square_norm") + 3.7e-4, 2).alias("log_norm"))

    return run


query("i4_derivative", SLOPE.format(gauss=GAUSS))(_slope("weak"))
query("i2_low_noise_derivative", SLOPE.format(gauss=GAUSS))(_slope("low_noise"))
query("i3_spline_derivative", SLOPE.format(gauss=GAUSS))(_slope("spline"))


# complex functions: a dozen, each of every twelfth supplier; quantities are the real, line numbers the imaginary part
TWELVE = "'k' || l_suppkey % 12"
COMPLEX_SQL = f"WITH {haar_sql(by=TWELVE)}, {haar_sql('l_linenumber', 'other', TWELVE)}, z AS (SELECT leaf.tree_id AS id, leaf.l, leaf.f AS f, g FROM leaf JOIN (SELECT tree_id, l, f AS g FROM other) o ON o.tree_id = leaf.tree_id AND o.l = leaf.l)"


def complex_functions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f, g = haar(spark, sf_dir, by=TWELVE), haar(spark, sf_dir, "l_linenumber", TWELVE)
    t = write_shared(f.withColumn("tree_id", F.concat("tree_id", F.lit("/re"))).unionByName(g.withColumn("tree_id", F.concat("tree_id", F.lit("/im")))))
    ids = t.select("tree_id").distinct().select(F.substring_index("tree_id", "/", 1).alias("fn_id"), F.lit(0).alias("comp"), F.substring_index("tree_id", "/", -1).alias("part"), "tree_id")
    return ids.select("*", F.lit(1.0).alias("c_re"), F.lit(0.0).alias("c_im"), F.lit(False).alias("conj"), F.lit(0).alias("label")), t


@query("g2_overlap_complex", f"{COMPLEX_SQL} SELECT a.id AS i, b.id AS j, round(sum(a.f * b.f + a.g * b.g) / {2**LEAF} + 3.7e-5, 2) AS re, round(sum(a.f * b.g - a.g * b.f) / {2**LEAF} + 3.7e-5, 2) AS im FROM z a JOIN z b ON a.l = b.l GROUP BY 1, 2")
def _(spark, sf_dir):
    """Hermitian overlaps of all pairs, in blocks of five trees."""
    functions, t = complex_functions(spark, sf_dir)
    real = linalg.overlap_matrix(t.select(*TREE_KEY, "coef"), HAAR, block=5)
    s = components._weighed(real, functions, functions)
    return s.select("i", "j", F.round(F.col("re") + 3.7e-5, 2).alias("re"), F.round(F.col("im") + 3.7e-5, 2).alias("im"))


@query("g5_rotate_complex", f"{COMPLEX_SQL}, u AS (SELECT id, CAST(substr(id, 2) AS INT) + 1 AS k FROM z GROUP BY 1), m AS (SELECT 'a' AS j, id, k * 0.5::DOUBLE AS re, 1.0::DOUBLE / k AS im FROM u UNION ALL SELECT 'b', id, -1.0::DOUBLE / k, k * 0.25::DOUBLE FROM u) SELECT m.j AS fn_id, round(sum(m.re * f - m.im * g) / {2**LEAF} + 3.7e-5, 2) AS integral_re, round(sum(m.re * g + m.im * f) / {2**LEAF} + 3.7e-5, 2) AS integral_im FROM z JOIN m ON m.id = z.id GROUP BY 1")
def _(spark, sf_dir):
    """Two complex combinations of the twelve, with one cut for real and imaginary part."""
    functions, t = complex_functions(spark, sf_dir)
    k = (F.substring("fn_id", 2, 9).cast("int") + 1).cast("double")
    ids = functions.select("fn_id").distinct()
    u = ids.select(F.col("fn_id").alias("i"), F.lit("a").alias("j"), (k * 0.5).alias("re"), (1 / k).alias("im")).union(ids.select("fn_id", F.lit("b"), -1 / k, k * 0.25))
    rows, out = components.rotate(functions, u, t, HAAR, prec=1e-9)
    j = rows.join(reduce.integrate(out, HAAR), "tree_id").groupBy("fn_id").agg(*[F.sum(F.when(F.col("part") == p, F.col("integral"))).alias(p) for p in ("re", "im")])
    return j.select("fn_id", *[F.round(F.col(p) + 3.7e-5, 2).alias(f"integral_{p}") for p in ("re", "im")])


@query("g7_orthogonalize_complex", f"""{COMPLEX_SQL}, n AS (SELECT sum(f * f + g * g) AS n FROM z WHERE id = 'k1'), o AS (SELECT b.id, sum(a.f * b.f + a.g * b.g) AS re, sum(a.f * b.g - a.g * b.f) AS im FROM z a JOIN z b ON a.l = b.l WHERE a.id = 'k1' GROUP BY 1)
SELECT o.id AS fn_id, round((sum(f * f + g * g) - any_value((re * re + im * im) / n)) / {2**LEAF} + 3.7e-5, 2) AS square_norm FROM z JOIN o ON o.id = z.id, n WHERE o.id <> 'k1' GROUP BY 1""")
def _(spark, sf_dir):
    """What is left of each function without its component along the first."""
    functions, t = complex_functions(spark, sf_dir)
    rows, out = components.orthogonalize(functions.where("fn_id <> 'k1'"), functions.where("fn_id = 'k1'"), t, HAAR)
    return components.square_norm(rows, out).select("fn_id", F.round(F.col("square_norm") + 3.7e-5, 2).alias("square_norm"))


# overlaps grow with the square of the table: they are given to nine digits in units of a power of ten, that of the largest square norm
@query("g8_orthonormalize_complex", f"{COMPLEX_SQL}, s AS (SELECT a.id AS i, b.id AS j, sum(a.f * b.f + a.g * b.g) / {2**LEAF} AS re, sum(a.f * b.g - a.g * b.f) / {2**LEAF} AS im FROM z a JOIN z b ON a.l = b.l GROUP BY 1, 2), u AS (SELECT CAST(floor(log10(max(re))) AS INT) AS exponent FROM s) SELECT i, j, exponent, round(re / pow(10, exponent) + 3.7e-11, 9) AS re, round(im / pow(10, exponent) + 3.7e-11, 9) AS im FROM s, u")
def _(spark, sf_dir):
    """The functions' overlaps with their Loewdin basis are the root of their own overlaps: its square gives these back."""
    functions, t = complex_functions(spark, sf_dir)
    rows, out = components.orthonormalize(functions, t, HAAR)
    out = out.withColumn("tree_id", F.concat(F.lit("o/"), "tree_id"))
    rows = rows.withColumn("tree_id", F.concat(F.lit("o/"), "tree_id"))
    m = write_shared(components.cross_overlap(functions, rows, write_shared(t.select(*TREE_KEY, "coef").unionByName(out.select(*TREE_KEY, "coef"))), HAAR))
    n = m.select(F.col("i").alias("k"), F.col("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    square = m.select("i", F.col("j").alias("k"), "re", "im").join(n, "k").groupBy("i", "j").agg(F.sum(F.col("re") * F.col("br") - F.col("im") * F.col("bi")).alias("re"), F.sum(F.col("re") * F.col("bi") + F.col("im") * F.col("br")).alias("im"))
    square = write_shared(square)
    unit = square.agg(F.floor(F.log10(F.max("re"))).cast("int").alias("exponent"))  # one row
    return square.join(F.broadcast(unit)).select("i", "j", "exponent", *[F.round(F.col(c) / F.pow(F.lit(10.0), F.col("exponent")) + 3.7e-11, 9).alias(c) for c in ("re", "im")])


# --- reductions and derivatives that need more than one tree ---------------------------------------------------------


@query("f2_integrate_side", f"""WITH {GAUSS}, p AS (SELECT fn_id, coef * sqrt(pi() / a0) AS i FROM gs) SELECT fn_id AS tree_id, round(sum(i) + 3.7e-5, 3) AS whole FROM p GROUP BY 1""")
def _(spark, sf_dir):
    """Integrals as sums of the halves left and right of the origin."""
    t = write_shared(project.project_gaussians(gaussians(spark, sf_dir, dim=1), LINE, 1e-8))
    left, right = (reduce.integrate_side(t, LINE, 0, positive).select("tree_id", F.col("integral").alias(name)) for positive, name in ((False, "a"), (True, "b")))
    return left.join(right, "tree_id").select("tree_id", F.round(F.col("a") + F.col("b") + 3.7e-5, 3).alias("whole"))


@query("e6_max_norm_products", f"WITH {GAUSS}, n AS (SELECT a.fn_id, {NORM_1D} AS q FROM gs a JOIN gs b ON a.fn_id = b.fn_id GROUP BY 1) SELECT fn_id AS tree_id, round(q + 3.7e-4, 2) AS integral FROM n")
def _(spark, sf_dir):
    """Squares of all functions on the grids that their largest norms call for, at a precision that leaves out much of the union grid."""
    t = write_shared(project.project_gaussians(gaussians(spark, sf_dir, dim=1), LINE, 1e-6))
    ids = t.select("tree_id").distinct().select(F.col("tree_id").alias("out_id"), F.col("tree_id").alias("a_id"), F.col("tree_id").alias("b_id"), F.lit(1.0).alias("c"))
    out = reduce.integrate(arith.multiply_max_norm(ids, t, LINE, 1e-4), LINE)
    return out.select("tree_id", F.round(F.col("integral") + 3.7e-4, 2).alias("integral"))


# derivatives at a point near each supplier's own Gaussian, of its nation's function
def _at_points_sql(what: str, scale: float) -> str:
    return f"WITH {GAUSS}, p AS (SELECT fn_id, term AS pid, x0 + 0.13 AS x FROM gs) SELECT p.pid, p.fn_id AS tree_id, round(sum(coef * ({what}) * exp(-a0 * (x - x0) * (x - x0))) / {scale} + 3.7e-3, 1) AS value FROM p JOIN gs ON gs.fn_id = p.fn_id GROUP BY 1, 2"


def _at_points(derive: Callable[[DataFrame], DataFrame], scale: float, prec: float = 1e-8) -> Callable[[SparkSession, str], DataFrame]:
    """prec: as the digits are fixed and the sums grow with the table, methods of low order need finer trees to give them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = gaussians(spark, sf_dir, dim=1)
        t = write_shared(derive(write_shared(project.project_gaussians(g, LINE, prec))))
        at = g.select(F.col("term").alias("pid"), F.col("fn_id").alias("tree_id"), (F.col("pos")[0] + 0.13).alias("x"))
        return reduce.evaluate(at, t, LINE).select("pid", "tree_id", F.round(F.col("value") / scale + 3.7e-3, 1).alias("value"))

    return run


SECOND, THIRD = "4 * a0 * a0 * (x - x0) * (x - x0) - 2 * a0", "12 * a0 * a0 * (x - x0) - 8 * pow(a0, 3) * pow(x - x0, 3)"
query("i2_second_low_noise", _at_points_sql(SECOND, 10))(_at_points(lambda t: derivative.low_noise(grid.refine_uniform(t, LINE, 3), LINE, 0, 2), 10, 1e-12))
query("i3_second_spline", _at_points_sql(SECOND, 10))(_at_points(lambda t: derivative.spline(t, LINE, 0, 2), 10))
query("i3_third_spline", _at_points_sql(THIRD, 100))(_at_points(lambda t: derivative.spline(t, LINE, 0, 3), 100, 1e-11))
query("i1_weak_at_points", _at_points_sql("-2 * a0 * (x - x0)", 1))(_at_points(lambda t: derivative.apply(t, LINE, 0), 1))


@query("f11_lattice_values", f"WITH {GAUSS}, i AS (SELECT range AS pid, -4 + 8 * range / 40.0 AS x FROM range(41)) SELECT pid, fn_id AS tree_id, round(sum(coef * exp(-a0 * (x - x0) * (x - x0))) + 3.7e-5, 2) AS value FROM i, gs GROUP BY 1, 2")
def _(spark, sf_dir):
    """All functions on a line of 41 points."""
    t = write_shared(project.project_gaussians(gaussians(spark, sf_dir, dim=1), LINE, 1e-8))
    names = [r[0] for r in t.select("tree_id").distinct().collect()]  # one for each nation
    at = reduce.lattice_points(t, names, [-4.0], [[8.0]], [41])
    return reduce.evaluate(at, t, LINE).select("pid", "tree_id", F.round(F.col("value") + 3.7e-5, 2).alias("value"))


@query("d5_project_on_grid", f"WITH {GAUSS} SELECT fn_id AS tree_id, CAST(64 AS BIGINT) AS n_end, round(sum(coef * sqrt(pi() / a0)) + 3.7e-4, 2) AS integral FROM gs GROUP BY 1")
def _(spark, sf_dir):
    """Projection on a fixed grid of half units about the origin, and of larger cells elsewhere."""
    g = gaussians(spark, sf_dir, dim=1)
    ids = g.select(F.col("fn_id").alias("tree_id")).distinct()
    fine = ids.select("tree_id", F.lit(1).alias("n"), F.explode(F.sequence(F.lit(-32), F.lit(31))).alias("lx"), F.lit(0).alias("ly"), F.lit(0).alias("lz"))
    t = write_shared(project.project_gaussians(g, LINE, -1.0, start=fine))
    ends = t.where("is_end").groupBy("tree_id").agg(F.count("*").alias("n_end"))
    return reduce.integrate(t, LINE).join(ends, "tree_id").select("tree_id", "n_end", F.round(F.col("integral") + 3.7e-4, 2).alias("integral"))


@query("e15_add_conjugates", f"{COMPLEX_SQL} SELECT id AS fn_id, round(sum(1.5 * f + 2 * g) / {2**LEAF} + 3.7e-7, 4) AS integral_re, round(sum(2 * f + 0.5 * g) / {2**LEAF} + 3.7e-7, 4) AS integral_im FROM z GROUP BY 1")
def _(spark, sf_dir):
    """F + (0.5 + 2i) times F's conjugate, for complex functions."""
    functions, t = complex_functions(spark, sf_dir)
    rows, out = components.add(functions, components.conjugate(functions), t, HAAR, 0.5 + 2j)
    j = rows.join(reduce.integrate(out, HAAR), "tree_id").groupBy("fn_id").agg(*[F.sum(F.when(F.col("part") == p, F.col("integral"))).alias(p) for p in ("re", "im")])
    return j.select("fn_id", *[F.round(F.col(p) + 3.7e-7, 4).alias(f"integral_{p}") for p in ("re", "im")])


# --- convolutions ---------------------------------------------------------------------------------------------------


@query("h4_apply_heat", f"WITH {GAUSS.replace(' gs AS', ' gs0 AS').replace('gs AS (', 'gs0 AS (', 1)}, gs AS (SELECT fn_id, coef * sqrt(1 / (1 + 0.2 * a0)) AS coef, a0 / (1 + 0.2 * a0) AS a0, x0 FROM gs0), i AS (SELECT fn_id, sum(coef * sqrt(pi() / a0)) AS i FROM gs GROUP BY 1), q AS (SELECT a.fn_id, {NORM_1D} AS q FROM gs a JOIN gs b ON a.fn_id = b.fn_id GROUP BY 1) SELECT i.fn_id AS tree_id, round(i / sqrt(q) + 3.7e-5, 3) AS integral, round(sqrt(q) + 3.7e-5, 3) AS norm FROM i JOIN q ON i.fn_id = q.fn_id")
def _(spark, sf_dir):
    """All Gaussian sums after heat has spread for a time of 0.05: wider Gaussians."""
    t = write_shared(project.project_gaussians(gaussians(spark, sf_dir, dim=1), LINE, 1e-6))
    oper = convolution.heat_operator(spark, LINE, 0.05, int(t.agg(F.max("n")).first()[0]) + 1)
    out = write_shared(convolution.apply(oper, t, LINE, 1e-6))
    j = reduce.integrate(out, LINE).join(reduce.square_norm(out), "tree_id")
    return j.select("tree_id", F.round(F.col("integral") / F.sqrt("square_norm") + 3.7e-5, 3).alias("integral"), F.round(F.sqrt("square_norm") + 3.7e-5, 3).alias("norm"))


STEPS = "steps AS (SELECT CAST(range AS DOUBLE) AS i FROM range(2001))"
SPACE = MRA(World(3, -2, (-1,) * 3, (2,) * 3), 5)
CHARGE = """gs AS (SELECT 'q' || s_nationkey % 5 AS fn_id, s_acctbal / 1000 AS coef, CAST(s_suppkey % 2 + 1 AS DOUBLE) AS a, s_suppkey % 17 / 8.5 - 1 AS x0, s_suppkey % 13 / 6.5 - 1 AS x1, s_suppkey % 11 / 5.5 - 1 AS x2 FROM supplier),
pairs AS (SELECT i.fn_id, i.coef * j.coef * pow(pi() / i.a, 1.5) * pow(pi() / j.a, 1.5) AS c, round(i.a * j.a / (i.a + j.a), 9) AS p, round(i.a * j.a / (i.a + j.a) * (pow(i.x0 - j.x0, 2) + pow(i.x1 - j.x1, 2) + pow(i.x2 - j.x2, 2)), 9) AS x FROM gs i JOIN gs j ON i.fn_id = j.fn_id)"""


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sums of Gaussians in space, of the suppliers of every fifth nation."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("q"), (F.col("s_nationkey") % 5).cast("string")).alias("fn_id"), k.cast("long").alias("term"), (F.col("s_acctbal") / 1000).alias("coef"),
        F.array_repeat((k % 2 + 1).cast("double"), 3).alias("alpha"), F.array(k % 17 / 8.5 - 1, k % 13 / 6.5 - 1, k % 11 / 5.5 - 1).alias("pos"), F.array_repeat(F.lit(0), 3).alias("power"),
    )


def energy_sql(mu: float) -> str:
    """Energies of a charge in its own field of kernel exp(-mu r) / r, as an integral over the unit interval for each pair of Gaussians."""
    at = f"exp(-x * i * i / 4e6 - CASE WHEN i = 0 THEN {'700' if mu else '0'} ELSE {mu * mu} * (4e6 - i * i) / (4 * p * i * i) END)"
    return f"""WITH {CHARGE}, {STEPS}, u AS (SELECT DISTINCT p, x FROM pairs), w AS (SELECT p, x, sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {at}) / 6e3 AS f FROM u, steps GROUP BY 1, 2)
SELECT fn_id AS tree_id, round(ln(sum(c * sqrt(4 * pairs.p / pi()) * f)) + 3.7e-4, 2) AS log_energy FROM pairs JOIN w ON w.p = pairs.p AND w.x = pairs.x GROUP BY 1"""


def field_energy(spark: SparkSession, sf_dir: str, mu: float) -> DataFrame:
    f = write_shared(project.project_gaussians(charges(spark, sf_dir), SPACE, 1e-3))
    depth = int(f.agg(F.max("n")).first()[0]) + 2
    oper = convolution.helmholtz_operator(spark, SPACE, mu, 1e-4, depth) if mu else convolution.poisson_operator(spark, SPACE, 1e-4, depth)
    v = write_shared(convolution.apply(oper, f, SPACE, 1e-3))
    own = f.select(F.col("tree_id").alias("bra_id"), F.col("tree_id").alias("ket_id")).distinct()
    return reduce.dot_pairs(own, f, v, SPACE).select(F.col("bra_id").alias("tree_id"), F.round(F.log("dot") + 3.7e-4, 2).alias("log_energy"))


@query("h4_apply_poisson", energy_sql(0.0))
def _(spark, sf_dir):
    """Electrostatic energies of sums of Gaussians in space: each with its own potential."""
    return field_energy(spark, sf_dir, 0.0)


@query("h4_apply_helmholtz", energy_sql(1.0))
def _(spark, sf_dir):
    """The same with the screened kernel exp(-r) / r."""
    return field_energy(spark, sf_dir, 1.0)


FREE = MRA(World(1, -3, (-1,), (2,)), 7)


@query("h11_time_evolution", f"""WITH {GAUSS}, z AS (SELECT a.fn_id, a.coef * b.coef AS c, a.a0 * b.a0 AS p, a.a0 + b.a0 AS s, 0.8 * a.a0 * b.a0 AS q, pow(a.x0 - b.x0, 2) AS d FROM gs a JOIN gs b ON a.fn_id = b.fn_id),
w AS (SELECT *, s * s + q * q AS zz FROM z), v AS (SELECT fn_id, sum(c * sqrt(pi() / s) * exp(-p * d / s)) AS n, sum(c * sqrt(pi()) * pow(zz, -0.25) * exp(-p * d * s / zz) * cos(p * d * q / zz - atan2(q, s) / 2)) AS re, sum(c * sqrt(pi()) * pow(zz, -0.25) * exp(-p * d * s / zz) * sin(p * d * q / zz - atan2(q, s) / 2)) AS im FROM w GROUP BY 1)
SELECT fn_id, round(sqrt(n) + 3.7e-4, 2) AS norm, round(re / n + 3.7e-5, 3) AS overlap_re, round(im / n + 3.7e-5, 3) AS overlap_im FROM v""")
def _(spark, sf_dir):
    """Each nation's sum of Gaussians as the state of a free particle, after a time of 0.2: its norm, and its overlap with the state before."""
    f = project.project_gaussians(gaussians(spark, sf_dir, dim=1), FREE, 1e-5)
    f = write_shared(f.withColumn("tree_id", F.concat("tree_id", F.lit("/re"))))
    out = write_shared(convolution.apply_complex(*convolution.time_evolution_operators(spark, FREE, 0.2, 5), f, FREE, 1e-5))
    fn = lambda c: F.regexp_extract(c, "^(.*)/", 1).alias("fn_id")
    before = reduce.square_norm(f).select(fn("tree_id"), F.col("square_norm").alias("n"))
    after = reduce.square_norm(out).groupBy(fn("tree_id")).agg(F.sum("square_norm").alias("m"))
    pairs = out.select("tree_id").distinct().select(F.concat(F.regexp_extract("tree_id", "^(.*)/", 1), F.lit("/re")).alias("bra_id"), F.col("tree_id").alias("ket_id"))
    dots = reduce.dot_pairs(pairs, f, out, FREE).groupBy(fn("bra_id")).agg(*[F.sum(F.when(F.col("ket_id").endswith(p), F.col("dot"))).alias(p) for p in ("re", "im")])
    j = before.join(after, "fn_id").join(dots, "fn_id")
    return j.select("fn_id", F.round(F.sqrt("m") + 3.7e-4, 2).alias("norm"), *[F.round(F.col(p) / F.col("n") + 3.7e-5, 3).alias(f"overlap_{p}") for p in ("re", "im")])


@query("h1_kernels", "SELECT c_custkey, round(1 / r, 2) AS poisson, round(exp(-0.5 * r) / r, 2) AS helmholtz, round(exp(-r * r / 0.2) / sqrt(0.2 * pi()), 6) AS heat FROM (SELECT c_custkey, 0.1 + abs(c_acctbal) / 20000 AS r FROM customer)")
def _(spark, sf_dir):
    """Kernels as sums of Gaussians, at a distance that each customer's balance names."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (0.1 + F.abs("c_acctbal") / 20000).alias("r"))
    sums = {"poisson": (K.poisson(1e-9, 1e-2, 2.0), 2), "helmholtz": (K.helmholtz(0.5, 1e-9, 1e-2, 2.0), 2), "heat": (K.heat(0.05, 1), 6)}
    value = lambda t: sum((F.lit(float(a)) * F.exp(-float(b) * F.col("r") * F.col("r")) for a, b in zip(*t, strict=True)), F.lit(0.0))
    return c.select("c_custkey", *[F.round(value(t), digits).alias(name) for name, (t, digits) in sums.items()])


# --- Gaussian tables ------------------------------------------------------------------------------------------------


@query("j1_gauss_eval", f"WITH {POINTS}, {GAUSS}, p AS (SELECT DISTINCT x, y FROM pts) SELECT fn_id, count(DISTINCT CASE WHEN abs(x - x0) <= sqrt(60 / a0) AND abs(y - x1) <= sqrt(60 / a1) THEN (x, y) END) AS n_points, round(sum(coef * CASE p0 WHEN 0 THEN 1 ELSE pow(x - x0, p0) END * CASE p1 WHEN 0 THEN 1 ELSE pow(y - x1, p1) END * exp(-a0 * (x - x0) * (x - x0)) * exp(-a1 * (y - x1) * (y - x1))), 4) AS total FROM p, gs GROUP BY 1")
def _(spark, sf_dir):
    """Every function at every distinct point that it reaches."""
    p = points(spark, sf_dir).select("x", "y").distinct().withColumn("pid", F.xxhash64("x", "y"))
    v = G.evaluate(p, gaussians(spark, sf_dir, powers=True), 2)
    return v.groupBy("fn_id").agg(F.count("*").alias("n_points"), F.round(F.sum("value"), 4).alias("total"))


@query("j3_square_norm", f"WITH {GAUSS} SELECT a.fn_id, round(sum(a.coef * b.coef * sqrt(pi() / (a.a0 + b.a0)) * exp(-a.a0 * b.a0 / (a.a0 + b.a0) * (a.x0 - b.x0) * (a.x0 - b.x0)) * sqrt(pi() / (a.a1 + b.a1)) * exp(-a.a1 * b.a1 / (a.a1 + b.a1) * (a.x1 - b.x1) * (a.x1 - b.x1))), 4) AS square_norm FROM gs a JOIN gs b ON a.fn_id = b.fn_id GROUP BY 1")
def _(spark, sf_dir):
    return G.square_norms(gaussians(spark, sf_dir), 2).select("fn_id", F.round("square_norm", 4).alias("square_norm"))


@query("j3_term_square_norm", f"WITH {GAUSS} SELECT fn_id, term, round(coef * coef * sqrt(pi() / (2 * a0)) * CASE p0 WHEN 2 THEN 3 ELSE 1 END / pow(4 * a0, p0) * sqrt(pi() / (2 * a1)) / pow(4 * a1, p1), 6) AS square_norm FROM gs")
def _(spark, sf_dir):
    return gaussians(spark, sf_dir, powers=True).select("fn_id", "term", F.round(G.term_square_norm(2), 6).alias("square_norm"))


@query("j5_multiply", f"WITH {GAUSS}, p AS (SELECT DISTINCT x FROM (SELECT l_quantity / 6.4 - 4 AS x FROM lineitem)), v AS (SELECT fn_id, x, sum(coef * exp(-a0 * (x - x0) * (x - x0))) AS v FROM p, gs GROUP BY 1, 2) SELECT fn_id, round(sum(v * v), 3) AS total FROM v GROUP BY 1")
def _(spark, sf_dir):
    """Squares as new Gaussian tables, summed over points."""
    g = gaussians(spark, sf_dir, dim=1)
    own = g.select(F.col("fn_id").alias("out_id"), F.col("fn_id").alias("a_id"), F.col("fn_id").alias("b_id")).distinct()
    p = points(spark, sf_dir).select("x").distinct().withColumn("pid", F.xxhash64("x"))
    return G.evaluate(p, G.multiply(own, g, g, 1), 1).groupBy("fn_id").agg(F.round(F.sum("value"), 3).alias("total"))


@query("j7_differentiate", f"WITH {GAUSS}, d AS (SELECT fn_id, term * 2 AS term, coef * p0 AS coef, CASE WHEN p0 > 0 THEN p0 - 1 ELSE p0 END AS power0 FROM gs UNION ALL SELECT fn_id, term * 2 + 1, -2 * a0 * coef, p0 + 1 FROM gs) SELECT fn_id, term, round(coef, 6) AS coef, power0 FROM d WHERE coef <> 0")
def _(spark, sf_dir):
    d = G.differentiate(gaussians(spark, sf_dir, powers=True), 0)
    return d.select("fn_id", "term", F.round("coef", 6).alias("coef"), F.col("power")[0].alias("power0"))


@query("j9_periodify", f"WITH {GAUSS}, w AS (SELECT fn_id, term, x0 - floor(x0 / 2) * 2 AS x0, x1 - floor(x1 / 2) * 2 AS x1, greatest(ceil((x0 - floor(x0 / 2) * 2 + 4 * greatest(1 / sqrt(2 * a0), 1 / sqrt(2 * a1))) / 2), ceil((x1 - floor(x1 / 2) * 2 + 4 * greatest(1 / sqrt(2 * a0), 1 / sqrt(2 * a1))) / 2), 0) AS m FROM gs) SELECT fn_id, term, CAST(pow(2 * m + 1, 2) AS BIGINT) AS n_images, round(x0, 6) AS mean_x FROM w")
def _(spark, sf_dir):
    g = G.periodify(gaussians(spark, sf_dir), [2.0, 2.0])
    return g.groupBy("fn_id", "term").agg(F.count("*").alias("n_images"), F.round(F.avg(F.col("pos")[0]), 6).alias("mean_x"))


@query("j10_screening", f"WITH {GAUSS} SELECT fn_id, term, round(x0 - sqrt(3 / a0), 6) AS lo_x, round(x1 + sqrt(3 / a1), 6) AS hi_y FROM gs")
def _(spark, sf_dir):
    g = gaussians(spark, sf_dir).select("fn_id", "term", *G.screen_box(3.0, 2))
    return g.select("fn_id", "term", F.round("lo_x", 6).alias("lo_x"), F.round("hi_y", 6).alias("hi_y"))


@query("j12_coulomb_energy", f"WITH {GAUSS}, {STEPS}, d AS (SELECT a.fn_id, a.a0 * b.a0 / (a.a0 + b.a0) AS al, pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2) AS r2 FROM gs a JOIN gs b ON a.fn_id = b.fn_id), v AS (SELECT fn_id, al, round(al * r2, 9) AS x FROM d), u AS (SELECT DISTINCT x FROM v), w AS (SELECT x, sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-x * i * i / 4e6)) / 6e3 AS f0 FROM u, steps GROUP BY 1) SELECT fn_id AS a_id, round(sum(sqrt(4 * al / pi()) * f0), 4) AS energy FROM v JOIN w ON w.x = v.x GROUP BY 1")
def _(spark, sf_dir):
    """Energies between the unit-charge Gaussians of each nation's suppliers."""
    a = gaussians(spark, sf_dir, dim=3).withColumn("alpha", F.array(*[F.col("alpha")[0]] * 3))
    own = a.select(F.col("fn_id").alias("a_id"), F.col("fn_id").alias("b_id")).distinct()
    return G.coulomb_energy(own, a, a).select("a_id", F.round("energy", 4).alias("energy"))


@query("j13_boys", f"WITH {STEPS}, c AS (SELECT c_custkey, abs(c_acctbal / 1000) AS x FROM customer) SELECT c_custkey, round(sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-x * i * i / 4e6)) / 6e3, 8) AS f0, round(sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-x * i * i / 4e6) * i * i / 4e6) / 6e3, 8) AS f1 FROM c, steps GROUP BY 1")
def _(spark, sf_dir):
    """The Boys function of order 0 and 1 at each customer's scaled balance."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.abs(F.col("c_acctbal") / 1000).alias("x"))
    return c.select("c_custkey", F.round(G.boys(0, F.col("x")), 8).alias("f0"), F.round(G.boys(1, F.col("x")), 8).alias("f1"))


@query("j4_overlap", f"WITH {GAUSS} SELECT a.fn_id AS a_id, b.fn_id AS b_id, round({NORM_1D}, 4) AS overlap FROM gs a JOIN gs b ON a.fn_id < b.fn_id GROUP BY 1, 2")
def _(spark, sf_dir):
    """Overlaps of all pairs of functions."""
    g = gaussians(spark, sf_dir, dim=1)
    ids = g.select("fn_id").distinct()
    pairs = ids.select(F.col("fn_id").alias("a_id")).join(F.broadcast(ids.select(F.col("fn_id").alias("b_id")))).where("a_id < b_id")
    return G.overlaps(pairs, g, g, 1).select("a_id", "b_id", F.round("overlap", 4).alias("overlap"))


@query("j6_add", f"WITH {GAUSS} SELECT 'all' AS fn_id, count(*) AS n_terms, count(*) - 1 AS last_term, round(sum(coef), 4) AS sum_coef FROM (SELECT coef FROM gs UNION ALL SELECT -2 * coef FROM gs)")
def _(spark, sf_dir):
    g = gaussians(spark, sf_dir)
    return G.add(g, G.scale(g, -2.0), fn_id="all").groupBy("fn_id").agg(F.count("*").alias("n_terms"), F.max("term").alias("last_term"), F.round(F.sum("coef"), 4).alias("sum_coef"))


@query("j8_poly_expand", f"WITH {GAUSS} SELECT fn_id, count(*) AS n_terms, round(sum(c), 4) AS sum_coef, CAST(sum(p) AS BIGINT) AS sum_power FROM (SELECT fn_id, coef AS c, 0 AS p FROM gs UNION ALL SELECT fn_id, 3 * coef, 2 FROM gs UNION ALL SELECT fn_id, 2 * coef, 1 FROM gs UNION ALL SELECT fn_id, 6 * coef, 3 FROM gs) WHERE c <> 0 GROUP BY 1")
def _(spark, sf_dir):
    """(coef + 3 coef x^2)(1 + 2 y) times each Gaussian, as monomials."""
    g = gaussians(spark, sf_dir)
    poly = F.array(F.array(F.col("coef"), F.lit(0.0), 3 * F.col("coef")), F.array(F.lit(1.0), F.lit(2.0)))
    rows = G.expand_polynomials(g.select("fn_id", "term", "alpha", "pos", poly.alias("poly")))
    return rows.groupBy("fn_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("coef"), 4).alias("sum_coef"), F.sum(F.col("power")[0] + F.col("power")[1]).alias("sum_power"))


@query("j11_normalize", f"WITH {GAUSS}, q AS (SELECT a.fn_id, {NORM_1D} AS q FROM gs a JOIN gs b ON a.fn_id = b.fn_id GROUP BY 1) SELECT gs.fn_id, term, round(coef / sqrt(q), 6) AS coef FROM gs JOIN q ON q.fn_id = gs.fn_id")
def _(spark, sf_dir):
    return G.normalize(gaussians(spark, sf_dir, dim=1), 1).select("fn_id", "term", F.round("coef", 6).alias("coef"))


@query("j14_analytic", "SELECT c_custkey, round(CASE WHEN u > 0 AND u < 9 THEN exp(-9 / (u * (9 - u))) ELSE 0 END, 9) AS bump FROM (SELECT c_custkey, CAST(c_acctbal / 1000 AS DOUBLE) AS u FROM customer)")
def _(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_acctbal") / 1000).alias("u"))
    return c.select("c_custkey", F.round(G.smooth_compact(F.col("u"), 0.0, 9.0), 9).alias("bump"))

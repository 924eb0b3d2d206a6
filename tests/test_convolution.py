"""Convolutions against closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mwspark.functions import gaussians as G
from mwspark.functions import kernels as K
from mwspark.functions.shared import write_shared
from mwspark.mra import MRA, World
from mwspark.operators import arith, convolution, project, reduce

UNIT = MRA(World(1, 0), 5, "legendre", 25)
SIGMA, DT = 1e-3, 5e-4
TERMS = "out_id string, tree_id string, c double"


def one(df, col):
    return {r["tree_id"]: r[col] for r in df.collect()}


def difference(spark, a, b, mra):
    """Square norm of a - b, by tree."""
    both = a.withColumn("tree_id", F.concat(F.lit("a/"), "tree_id")).unionByName(b.withColumn("tree_id", F.concat(F.lit("b/"), "tree_id")))
    ids = [r[0] for r in a.select("tree_id").distinct().collect()]
    terms = spark.createDataFrame([(i, f"a/{i}", 1.0) for i in ids] + [(i, f"b/{i}", -1.0) for i in ids], TERMS)
    return one(reduce.square_norm(arith.add(terms, both, mra)), "square_norm")


@pytest.fixture(scope="module")
def narrow(spark):
    g = spark.createDataFrame([("a", 0, 1.0, [1 / SIGMA], [0.5], [0])], G.ROW)
    return write_shared(project.project_gaussians(g, UNIT, 1e-8))


@pytest.fixture(scope="module")
def wide(spark):
    g = spark.createDataFrame([("a", 0, 1.0, [50.0], [0.5], [0])], G.ROW)
    return write_shared(project.project_gaussians(g, UNIT, 1e-3))


def test_kernels_have_the_known_ranks_and_precision():
    coef, beta = K.poisson(1e-4, 1e-3, 1.0)
    r = np.geomspace(1e-3, 1, 30)
    assert len(coef) == 26 and np.allclose((coef * np.exp(-beta * r[:, None] ** 2)).sum(1) * r, 1, rtol=2e-4)
    coef, beta = K.helmholtz(0.01, 1e-4, 1e-3, 1.0)
    assert len(coef) == 33 and np.allclose((coef * np.exp(-beta * r[:, None] ** 2)).sum(1) * r, np.exp(-0.01 * r), rtol=2e-4)


@pytest.mark.parametrize("basis", ["legendre", "interpolating"])
def test_blocks_are_integrals_of_the_kernel(basis):
    k, n, beta = 2, 1, 7.0
    blocks = convolution.blocks_of(beta, 0, n, 2, k, basis, 1.0)
    from mwspark.functions import basis as B

    x, w = np.polynomial.legendre.leggauss(60)
    x, w = (x + 1) / 2, w / 2
    v = B.scaling_values(k, basis, x)
    for dl in (-2, 0, 1):
        kernel = np.exp(-beta * (0.5 * (x[:, None] - x[None] - dl)) ** 2) * 0.5
        assert np.allclose(blocks[dl + 2][: k + 1, : k + 1], (v * w[:, None]).T @ kernel @ (v * w[:, None]), atol=1e-10)


def test_heat_of_a_gaussian_is_a_gaussian(spark, narrow):
    oper = convolution.heat_operator(spark, UNIT, DT, 10)
    out = write_shared(convolution.apply(oper, narrow, UNIT, 1e-8))
    wide = SIGMA + 4 * DT
    g = spark.createDataFrame([("a", 0, (SIGMA / wide) ** 0.5, [1 / wide], [0.5], [0])], G.ROW)
    assert difference(spark, out, project.project_gaussians(g, UNIT, 1e-8), UNIT)["a"] < 1e-8**2 / 1000


def test_identity_keeps_the_integral_and_bands_shrink(spark, wide):
    kernel = K.table(spark, K.rows("identity", K.identity(1e-7, 1)))
    table = write_shared(convolution.build_operator(kernel, UNIT, 12))
    widths = {(r.depth, r.component): r.width for r in convolution.band_widths(table, UNIT, 1e-3).collect()}
    assert all(w <= 3 for (depth, part), w in widths.items() if part == 3) and widths[5, 0] > widths[3, 0]
    out = convolution.apply(convolution.collect_operator(table, {0: 1.0}, UNIT, (0,)), wide, UNIT, 1e-3)
    assert one(reduce.integrate(out, UNIT), "integral") == pytest.approx(one(reduce.integrate(wide, UNIT), "integral"), rel=1e-4)


def test_components_complex_and_local_precision(spark, wide):
    oper = convolution.heat_operator(spark, UNIT, DT, 7)
    both = wide.withColumn("tree_id", F.lit("f/re")).unionByName(wide.withColumn("tree_id", F.lit("f/im")))
    out = convolution.apply_complex(oper, oper, write_shared(both), UNIT, 1e-3)
    whole = one(reduce.integrate(wide, UNIT), "integral")["a"]
    got = one(reduce.integrate(out, UNIT), "integral")  # (1 + i)(f + i f) = 2 i f
    assert abs(got["f/re"]) < 1e-10 and got["f/im"] == pytest.approx(2 * whole, rel=1e-4)
    functions = spark.createDataFrame([("f", 0, "a"), ("f", 1, "a")], "fn_id string, comp int, tree_id string")
    rows, trees = convolution.apply_components(oper, functions, wide, {(0, 0): 2.0, (1, 0): 1.0, (0, 1): -1.0}, UNIT, 1e-3)
    assert {r.tree_id for r in rows.collect()} == {"f/0", "f/1"}
    assert one(reduce.integrate(trees, UNIT), "integral") == pytest.approx({"f/0": 3 * whole, "f/1": -whole}, rel=1e-4)
    finer = convolution.apply(oper, wide, UNIT, 1e-2, prec_trees=wide)
    assert one(reduce.integrate(finer, UNIT), "integral")["a"] == pytest.approx(whole, rel=1e-3)


def test_periodic_near_and_far_fields_add_up(spark):
    m = MRA(World(1, 0, periodic=(True,)), 5, "legendre", 20)
    g = spark.createDataFrame([("a", 0, 1.0, [60.0], [0.1], [0])], G.ROW)
    f = write_shared(project.project_gaussians(G.periodify(g, [1.0]), m, 1e-3))
    oper = convolution.heat_operator(spark, m, 1e-3, 7, reach=2)
    parts = {kind: one(reduce.integrate(convolution.apply(oper, f, m, 1e-3, field=kind), m), "integral")["a"] for kind in (None, "near", "far")}
    whole = one(reduce.integrate(f, m), "integral")["a"]
    assert parts[None] == pytest.approx(whole, rel=1e-3) and parts["near"] + parts["far"] == pytest.approx(whole, rel=1e-3) and 0 < parts["far"] < parts["near"]


def test_cartesian_and_derivative_kernels(spark, narrow):
    d = convolution.apply(convolution.derivative_operator(spark, UNIT, 1e-6, 14), narrow, UNIT, 1e-4)
    g = spark.createDataFrame([("a", 0, 1.0, [1 / SIGMA], [0.5], [0])], G.ROW)
    want = G.square_norms(G.differentiate(g, 0), 1).first()["square_norm"]
    assert one(reduce.square_norm(d), "square_norm")["a"] == pytest.approx(want, rel=1e-2)
    x1 = convolution.apply(convolution.cartesian_operator(spark, K.heat(DT, 1), (1,), UNIT, 9), narrow, UNIT, 1e-5)
    # x exp(-x^2 / (4t)) / sqrt(4 pi t) is -2t times the derivative of the heat kernel
    wide = SIGMA + 4 * DT
    after = spark.createDataFrame([("a", 0, -2 * DT * (SIGMA / wide) ** 0.5, [1 / wide], [0.5], [0])], G.ROW)
    want = G.square_norms(G.differentiate(after, 0), 1).first()["square_norm"]
    assert one(reduce.square_norm(x1), "square_norm")["a"] == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("basis", ["legendre", "interpolating"])
def test_a_block_is_a_sum_over_all_pairs_of_cells(basis):
    m = MRA(World(2, 0), 1, basis)
    rng = np.random.default_rng(4)
    blocks = {n: {0: {0: {g: rng.normal(size=(4, 4)) for g in range(-2, 2)}}, 1: {0: {g: rng.normal(size=(4, 4)) for g in (0, 1)}}} for n in (0, 3)}
    norms = {n: {t: {0: {g: (float(np.linalg.norm(b)), float(np.linalg.norm(b))) for g, b in x[0].items()}} for t, x in by.items()} for n, by in blocks.items()}
    oper = convolution.Operator(blocks, norms, {0: 1.0, 1: -1.0}, (0, 0))
    for n, at in ((3, np.array([[x, y, 0] for x in range(8) for y in range(8) if (x * y) % 3 != 1])), (0, np.array([[0, 0, 0], [1, 0, 0], [3, 2, 0]]))):
        coef = rng.normal(size=(len(at), 16))
        out = at[::2]
        got = {}
        for slab in (1, 1 << 20):
            convolution.SLAB = slab
            got[slab] = convolution.convolve_block(out, n, convolution.Cells(n, np.full(len(at), n), at, coef, m), oper, m, 1e-300)
        want = np.zeros_like(got[1])
        for i, o in enumerate(out):
            for a, c in zip(at, coef, strict=True):
                gx, gy = (a - o)[:2]
                for t, sign in oper.sign.items():
                    bx, by = blocks[n][t][0].get(gx), blocks[n][t][0].get(gy)
                    if bx is not None and by is not None:
                        full = np.einsum("aibj,ckdl,dblj->caki", bx.reshape(2, 2, 2, 2), by.reshape(2, 2, 2, 2), c.reshape(2, 2, 2, 2))
                        if n:
                            full[0, 0] -= np.einsum("ij,kl,lj->ki", bx[:2, :2], by[:2, :2], c.reshape(2, 2, 2, 2)[0, 0])
                        want[i] += sign * full.ravel()
        assert np.allclose(got[1], want) and np.allclose(got[1 << 20], want)
    convolution.SLAB = 4 << 20


def test_cells_below_leaves_are_generated():
    m = MRA(World(2, 0), 2, "legendre")
    rng = np.random.default_rng(4)
    leaf, cell = rng.normal(size=(1, 36)), rng.normal(size=(1, 36))
    cells = convolution.Cells(3, np.array([1, 3]), np.array([[0, 1, 0], [7, 7, 0]]), np.vstack([leaf, cell]), m)
    got = cells.get(np.array([[7, 7, 0], [1, 6, 0], [6, 6, 0], [-3, 0, 0]]), 3)
    from mwspark.functions import basis as B

    up = B.reconstruct(leaf, 2, 2, "legendre").reshape(4, 9)[2]  # x: 0 -> 0, y: 1 -> 3 at scale 2
    down = B.reconstruct(np.concatenate([up, np.zeros(27)])[None], 2, 2, "legendre").reshape(4, 9)[1]
    assert np.allclose(got[0], cell) and np.allclose(got[1, :9], down) and not got[1, 9:].any() and not got[2:].any()


def test_trees_are_judged_by_their_own_norms(spark):
    rows = [(name, 0, c, [200.0], [0.5], [0]) for name, c in (("small", 1e-4), ("big", 1e4), ("tiny", 1e-12))]
    f = write_shared(project.project_gaussians(spark.createDataFrame(rows, G.ROW), UNIT, 1e-6))
    out = write_shared(convolution.apply(convolution.heat_operator(spark, UNIT, DT, 8), f, UNIT, 1e-6))
    got, before = one(reduce.integrate(out, UNIT), "integral"), one(reduce.integrate(f, UNIT), "integral")
    assert all(got[name] == pytest.approx(before[name], rel=1e-6) for name in ("small", "big", "tiny"))
    grids = {name: set(out.where(F.col("tree_id") == name).select("n", "lx").collect()) for name in got}
    assert grids["small"] == grids["big"] and len(grids["big"]) > 10  # the least wavelet norm that splits a cell is absolute, so tiny has fewer


def test_poisson_self_energy(spark):
    m = MRA(World(3, -2, (-1,) * 3, (2,) * 3), 5, "interpolating", 10)
    beta = 3.0
    rows = [(name, 0, c * (beta / np.pi) ** 1.5, [beta] * 3, [0.3, 0.2, 0.1], [0] * 3) for name, c in (("a", 1.0), ("b", 1e-5))]
    f = write_shared(project.project_gaussians(spark.createDataFrame(rows, G.ROW), m, 1e-3))
    v = convolution.apply(convolution.poisson_operator(spark, m, 1e-3, 3), f, m, 1e-3)
    pairs = spark.createDataFrame([("a", "a"), ("b", "b")], "bra_id string, ket_id string")
    got = {r.bra_id: r.dot for r in reduce.dot_pairs(pairs, f, v, m).collect()}
    assert got["a"] == pytest.approx((2 * beta / np.pi) ** 0.5, rel=1e-3) and got["b"] == pytest.approx(1e-10 * (2 * beta / np.pi) ** 0.5, rel=1e-3)


def free_particle(t, part, x0=0.5, sigma=1e-3):
    def f(x):
        z = 4j * t + sigma
        v = np.sqrt(sigma) / np.sqrt(z) * np.exp(-((x[:, 0] - x0) ** 2) / z)
        return v.real if part == "re" else v.imag

    return f


def test_time_evolution_moves_a_free_particle(spark):
    m, prec, dt = MRA(World(1, 0), 4, "legendre", 25), 1e-7, 0.03
    before = write_shared(project.project_functions(spark, m, {f"f/{p}": free_particle(1e-3, p) for p in ("re", "im")}, prec))
    after = write_shared(project.project_functions(spark, m, {f"f/{p}": free_particle(1e-3 + dt, p) for p in ("re", "im")}, prec))
    real, imag = convolution.time_evolution_operators(spark, m, dt, 7)
    out = write_shared(convolution.apply_complex(real, imag, before, m, prec))
    error = difference(spark, out, after, m)
    assert error["f/re"] < prec**2 / 50 and error["f/im"] < prec**2 / 50, error


def test_time_evolution_blocks_are_small_near_the_diagonal(spark):
    m = MRA(World(1, 0), 4, "legendre", 25)
    table = write_shared(convolution.build_time_evolution(spark, m, 0.01, 5))
    widths = {(r.oper_id, r.depth, r.component): r.width for r in convolution.corner_widths(table, m, 1e-5).collect()}
    assert widths["re", 0, 0] == 0 and widths["re", 5, 1] > 2 * widths["re", 4, 1] > 0 and all(c or not d for _, d, c in widths)
    # blocks made in stretches and by finer quadrature are the same
    kernel = lambda x: np.exp(1j * x * x / 0.04) / np.sqrt(0.04j * np.pi)
    whole = convolution.blocks_between(kernel, 5, -31, 31, 4, "legendre", 1.0, 3)
    got = {(r.oper_id, r.dl): r.block for r in table.where("n = 5").collect()}
    assert all(np.allclose(b, (whole.real if part == "re" else whole.imag)[dl + 31].ravel(), atol=1e-13) for (part, dl), b in got.items()) and len(got) > 50

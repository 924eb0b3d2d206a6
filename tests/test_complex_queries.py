"""Queries of complex functions, each of every twelfth supplier, against numpy on a small table with more suppliers than functions."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from mwspark.jobs.queries import ORACLES, QUERIES, complex_functions


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """(folder, the functions' values in 64 cells): suppliers 0 to 40, so that most functions are sums over several."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({
        "l_orderkey": np.arange(3000), "l_partkey": rng.integers(0, 500, 3000), "l_suppkey": rng.integers(0, 41, 3000),
        "l_linenumber": rng.integers(1, 8, 3000).astype("int32"), "l_quantity": rng.integers(1, 51, 3000).astype(float),
    })
    folder = tmp_path_factory.mktemp("lineitem")
    rows.to_parquet(folder / "lineitem.parquet")
    z = np.zeros((12, 64), complex)
    np.add.at(z, (rows.l_suppkey % 12, rows.l_partkey % 64), rows.l_quantity + 1j * rows.l_linenumber)
    return str(folder), z


def test_one_function_for_every_twelfth_supplier(spark, small):
    """the functions are grouped by an expression of the supplier, not by a column of that name."""
    folder, z = small
    functions, t = complex_functions(spark, folder)
    assert {r.fn_id for r in functions.collect()} == {f"k{i}" for i in range(12)}
    root = {r.tree_id: r.coef[0] for r in t.where("n = 0").collect()}
    assert len(root) == 24
    assert all(np.isclose(root[f"k{i}/{part}"], x.sum() / 64) for i, row in enumerate(z) for part, x in (("re", row.real), ("im", row.imag)))


def test_e15_add_conjugates(spark, small):
    folder, z = small
    got = {r.fn_id: r.integral_re + 1j * r.integral_im for r in QUERIES["e15_add_conjugates"](spark, folder).collect()}
    want = {f"k{i}": x for i, x in enumerate((z + (0.5 + 2j) * z.conj()).sum(1) / 64)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_g2_overlap_complex(spark, small):
    folder, z = small
    got = {(r.i, r.j): r.re + 1j * r.im for r in QUERIES["g2_overlap_complex"](spark, folder).collect()}
    want = {(f"k{i}", f"k{j}"): x for (i, j), x in np.ndenumerate(z.conj() @ z.T / 64)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.01 for k in want)


def test_digits_of_large_overlaps(spark, small, tmp_path):
    """F2: sums as large as those at 60 times sf0.1, whose halves of a last digit are exact."""
    rows = pd.read_parquet(f"{small[0]}/lineitem.parquet")
    path = tmp_path / "lineitem.parquet"
    rows.assign(l_quantity=rows.l_quantity * 12001, l_linenumber=rows.l_linenumber * 12001).to_parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS FROM '{path}'")
    want = {(i, j): (re, im) for i, j, re, im in duck.sql(f"SELECT i, j, re, im FROM ({ORACLES['g2_overlap_complex']})").fetchall()}
    got = {(r.i, r.j): (r.re, r.im) for r in QUERIES["g2_overlap_complex"](spark, str(tmp_path)).collect()}
    assert max(re for re, _ in want.values()) > 1e12
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in want) == 0


def test_g5_rotate_complex(spark, small):
    folder, z = small
    got = {r.fn_id: r.integral_re + 1j * r.integral_im for r in QUERIES["g5_rotate_complex"](spark, folder).collect()}
    k = np.arange(1, 13)
    want = {"a": (k * 0.5 + 1j / k) @ z.sum(1) / 64, "b": (-1 / k + 0.25j * k) @ z.sum(1) / 64}
    assert got.keys() == want.keys() and all(abs(got[j] - want[j]) < 0.01 for j in want)


def test_g7_orthogonalize_complex(spark, small):
    folder, z = small
    got = {r.fn_id: r.square_norm for r in QUERIES["g7_orthogonalize_complex"](spark, folder).collect()}
    rest = z - np.outer(z @ z[1].conj() / (abs(z[1]) ** 2).sum(), z[1])
    want = {f"k{i}": (abs(x) ** 2).sum() / 64 for i, x in enumerate(rest) if i != 1}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.01 for k in want)


def test_g8_orthonormalize_complex(spark, small):
    folder, z = small
    got = {(r.i, r.j): (r.re + 1j * r.im) * 10.0**r.exponent for r in QUERIES["g8_orthonormalize_complex"](spark, folder).collect()}
    s = z.conj() @ z.T / 64
    assert len(got) == 144 and all(abs(got[f"k{i}", f"k{j}"] - x) < 1e-8 * abs(s).max() for (i, j), x in np.ndenumerate(s))

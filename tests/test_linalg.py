"""Matrices over sets of functions, in blocks and whole."""

import numpy as np
import pytest

from mwspark.mra import MRA, World
from mwspark.operators import linalg
from mwspark.operators.transform import compress_up

M = MRA(World(1, 0), 1, "legendre")


def matrix(df, names, im=False):
    at = {x: i for i, x in enumerate(names)}
    out = np.zeros((len(names), len(names)), complex)
    for r in df.collect():
        out[at[r.i], at[r.j]] = r.re + (1j * r.im if im else 0)
    return out


def rows(s, names):
    return [(a, b, float(s[i, j].real), float(s[i, j].imag)) for i, a in enumerate(names) for j, b in enumerate(names)]


@pytest.mark.parametrize("block", [2048, 4])
def test_root_of_a_hermitian_matrix(spark, block):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(10, 10)) + 1j * rng.normal(size=(10, 10))
    s = a @ a.conj().T / 10 + 0.05 * np.eye(10)
    names = [f"f{i}" for i in range(10)]
    got = matrix(linalg.lowdin_matrix(spark.createDataFrame(rows(s, names), "i string, j string, re double, im double"), block), names, True)
    assert np.allclose(got @ s @ got, np.eye(10), atol=1e-8) and np.allclose(got, got.conj().T, atol=1e-9)


def test_dependent_functions(spark):
    s = np.diag([2.0, 1.0, 0.0]) + 0j
    s[:2, :2] += 0.5
    df = spark.createDataFrame(rows(s, "abc"), "i string, j string, re double, im double")
    got = matrix(linalg.lowdin_matrix(df.drop("im")), "abc")
    assert np.allclose((got @ s @ got)[:2, :2], np.eye(2)) and abs(got[2]).max() == 0
    with pytest.raises(ValueError, match="dependent"):
        linalg.lowdin_matrix(df, 2).collect()


@pytest.mark.parametrize("block", [2048, 3])
def test_overlaps_in_blocks(spark, block):
    rng = np.random.default_rng(1)
    rows_ = [(f"f{i}", 3, x, 0, 0, rng.normal(size=2).tolist()) for i in range(9) for x in range(8) if rng.random() < 0.6]
    nodes = compress_up(spark.createDataFrame(rows_, "tree_id string, n int, lx int, ly int, lz int, s array<double>"), M)
    held = {}
    for t, _, x, _, _, s in rows_:
        held.setdefault(t, np.zeros((8, 2)))[x] = s
    names = sorted(held)
    want = np.array([[(held[a] * held[b]).sum() for b in names] for a in names])
    assert np.allclose(matrix(linalg.overlap_matrix(nodes, M, block=block), names), want)
    some = nodes.where("tree_id < 'f4'")
    cross = {(r.i, r.j): r.re for r in linalg.cross_overlap(some, nodes, M, block=block).collect()}
    assert cross and all(np.isclose(v, want[names.index(i), names.index(j)]) for (i, j), v in cross.items())


def test_inverse_root_of_a_large_dependent_set():
    rng = np.random.default_rng(4)
    f = 1e6 * rng.uniform(1, 2, (4, 64)).astype(complex)[np.arange(12) % 4]
    s = f @ f.conj().T
    root = s @ linalg._inverse_root(s)
    assert np.abs(root @ root - s).max() < 1e-11 * np.abs(s).max()

import numpy as np
import pytest

from mwspark.functions import basis as B
from mwspark.mra import MRA, World, cube


@pytest.mark.parametrize("basis", ["legendre", "interpolating"])
@pytest.mark.parametrize("k", [0, 1, 3, 7])
def test_filters_are_orthogonal_and_two_scale(basis, k):
    f = B.filters(k, basis)
    assert np.allclose(f @ f.T, np.eye(2 * k + 2), atol=1e-12)
    x, w = B.quadrature(k + 1)
    v = B.scaling_values(k, basis, x)
    assert np.allclose((v * w[:, None]).T @ v, np.eye(k + 1), atol=1e-12)
    # a parent's function is the sum of its children's
    y = np.array([0.13, 0.4])
    child = np.sqrt(2) * B.scaling_values(k, basis, 2 * y)
    assert np.allclose(B.scaling_values(k, basis, y), child @ f[: k + 1, : k + 1].T)


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_compress_and_values_round_trip(dim):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, (2 * 4) ** dim))
    back = B.reconstruct(B.compress(a, dim, 3, "interpolating"), dim, 3, "interpolating")
    assert np.allclose(a, back)
    v = rng.normal(size=(5, 4**dim))
    n = np.arange(5)
    c = B.values_to_coefs(v, dim, 3, "legendre", n, 2.0)
    assert np.allclose(B.coefs_to_values(c, dim, 3, "legendre", n, 2.0), v)


def test_worlds():
    assert cube(3, 16) == World(3, -4, (-1,) * 3, (2,) * 3)
    assert World(2).upper(0) == 1.0 and cube(1, 4).lower(0) == -4.0
    with pytest.raises(ValueError):
        MRA(World(1), 3).check(MRA(World(1), 4))
    with pytest.raises(ValueError):
        cube(1, 3)

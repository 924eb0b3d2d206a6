"""Sums of Gaussians on the points of cells, against their terms one by one."""

import numpy as np
import pandas as pd
import pytest

from mwspark.mra import AXES, MRA, World
from mwspark.operators import project


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_values_are_sums_of_terms(dim, monkeypatch):
    rng = np.random.default_rng(dim)
    mra = MRA(World(dim, -1, (-1,) * dim, (2,) * dim, sf=(1.0, 2.0, 0.5)[:dim]), 2)
    cells = pd.DataFrame({"n": [0, 1, 2, 1]} | {a: rng.integers(-2, 2, 4) if d < dim else 0 for d, a in enumerate(AXES)})
    terms = pd.DataFrame({"coef": rng.normal(size=9), **{c: list(rng.uniform(lo, 2, (9, dim))) for c, lo in (("alpha", 0.3), ("pos", -2))}, "power": list(rng.integers(0, 3, (9, dim)))})
    cell, term = rng.integers(0, 3, 30), rng.integers(0, 9, 30)
    want = np.zeros((4, mra.blocks * mra.size))
    np.add.at(want, cell, project.gaussian_values(terms.iloc[term], project.cell_points(cells.iloc[cell], mra)))
    with monkeypatch.context() as m:
        # one by one would ask for these
        m.setattr(project, "gaussian_values", lambda *a: pytest.fail("values of single terms"))
        m.setattr(project, "PAIRS_AT_ONCE", 7)
        assert project._values_on(cells, cell, terms, term, mra) == pytest.approx(want, abs=1e-12)

"""Text exchange of trees, there and back."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from mwspark.functions.shared import write_shared
from mwspark.mra import MRA, World
from mwspark.operators import project
from mwspark.sources.trees import export_leaf_text, import_leaf_text

KEY = ["tree_id", "n", "lx", "ly", "lz"]


@pytest.mark.parametrize(("dim", "basis", "cells"), [(1, "legendre", None), (2, "interpolating", 3), (3, "interpolating", None)])
def test_round_trip(spark, tmp_path, dim, basis, cells):
    m = MRA(World(dim, -1, (-1,) * dim, (2,) * dim, (1.5,) * dim), 2, basis)
    fs = {"a/1": lambda x: np.exp(-9 * ((x - 0.3) ** 2).sum(1)), "007": lambda x: x[:, 0] + 2 * x[:, -1] + 1}
    before = write_shared(project.project_functions(spark, m, fs, 1e-2, max_iter=3))
    export_leaf_text(before, m, f"{tmp_path}/t", cells)
    after = import_leaf_text(spark, f"{tmp_path}/t", m)
    got, want = ({tuple(r[k] for k in KEY): r for r in x.collect()} for x in (after, before))
    assert got.keys() == want.keys() and all(np.allclose(got[k].coef, want[k].coef, atol=1e-12) and got[k].is_end == want[k].is_end for k in want)
    files = glob.glob(f"{tmp_path}/t/tree_id=*/part=*/*.txt")
    assert len(files) == 2 if cells is None else len(files) > 4
    text = open(files[0]).read().split("\n")
    assert text[0] == str(dim) and text[1] == "-3 3" and text[dim + 1] == "3" and 2 * int(text[dim + 2]) == len([x for x in text if x]) - dim - 3
    with pytest.raises(ValueError, match="world or order"):
        import_leaf_text(spark, f"{tmp_path}/t", MRA(m.world, 3, basis))


def test_missing_siblings_are_zero(spark, tmp_path):
    m = MRA(World(1, -1, (-1,), (2,)), 1, "legendre")
    before = write_shared(project.project_functions(spark, m, {"a": lambda x: x[:, 0] + 3}, 1e-30, max_iter=2))
    gone = before.where("not (is_end and n = 1 and lx = 2)")
    export_leaf_text(gone, m, f"{tmp_path}/t")
    after = {(r.n, r.lx): r for r in import_leaf_text(spark, f"{tmp_path}/t", m).collect()}
    want = {(r.n, r.lx): r for r in before.collect()}
    assert after.keys() == want.keys()
    for key, r in want.items():
        if r.is_end:
            assert np.allclose(after[key].coef, 0 if key == (1, 2) else r.coef, atol=1e-12)

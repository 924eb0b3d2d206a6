"""Projection of functions onto adaptive trees, all functions of a table at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.functions import basis as B
from mwspark.functions.gaussians import merged
from mwspark.functions.trees import NODE, keys_of, with_norms, write_shared
from mwspark.mra import AXES, KEY, MRA, TREE_KEY
from mwspark.operators.keys import children, parent_key, root_cells
from mwspark.operators.transform import from_values, rebuild

TWO_E_15 = 2e-15


def threshold(prec: float, norm, n, split_factor: float = 1.0):
    """A node splits where its wavelet norm is above this (Column)."""
    return F.greatest(F.lit(TWO_E_15), F.lit(prec) * norm * F.pow(F.lit(2.0), -0.5 * split_factor * (n + 1)))


def cell_points(pdf: pd.DataFrame, mra: MRA) -> np.ndarray:
    """Physical quadrature points of the children of each cell: (cells, 2^D K^D, D)."""
    unit, _ = B.lattice(mra.dim, mra.k)
    local = ((B.child_steps(mra.dim)[:, None] + unit[None]) / 2).reshape(-1, mra.dim)
    l = pdf[list(AXES[: mra.dim])].to_numpy(float)
    side = 2.0 ** -pdf["n"].to_numpy(float)
    return (l[:, None] + local[None]) * side[:, None, None] * np.array(mra.world.sf)


Evaluate = Callable[[pd.DataFrame, np.ndarray], np.ndarray]


def project(cells: DataFrame, mra: MRA, values: Evaluate, prec: float = -1.0, max_iter: int = -1, abs_prec: bool = False, payload: list[str] | None = None) -> DataFrame:
    """Trees with norms for the start cells (tree_id, n, l.., payload).

    values(rows, points) gives each row's function at its points (rows, points, D).
    """
    payload = payload or []
    kinds = dict(cells.dtypes)
    schema = f"{NODE}{''.join(f', {p} {kinds[p]}' for p in payload)}"

    def run(frames):
        for pdf in frames:
            if len(pdf):
                x = cell_points(pdf, mra)
                v = np.asarray(values(pdf, x), float).reshape(len(pdf), -1)
                out = keys_of(pdf).assign(is_end=True, coef=list(from_values(v, pdf.n.to_numpy(), mra)))
                yield out.assign(**{p: pdf[p].to_numpy() for p in payload}) if payload else out

    return adaptive(cells, lambda level: level.mapInPandas(run, schema), mra, prec, max_iter, abs_prec, payload)


def adaptive(
    cells: DataFrame, calc: Callable[[DataFrame], DataFrame], mra: MRA, prec: float = -1.0, max_iter: int = -1, abs_prec: bool = False, payload: list[str] | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None, local: Callable[[DataFrame], DataFrame] | None = None, split: Column | None = None,
) -> DataFrame:
    """Builds trees from start cells: calc gives the coefficients of new cells, which split where they need to.

    prec < 0 or max_iter 0 keeps the grid. A cell splits by the tree's running norm: the scaling norm of the start
    cells and all wavelet norms so far. Each pass is written, so that no plan grows with the depth.
    finish gets all nodes, inner ones too, as calc made them; without it the tree is rebuilt from its leaves. local adds to
    cells the factor tight by which the precision is sharper there. split (a Column) replaces the test by norms.
    """
    payload = payload or []
    done: DataFrame | None = None
    inner: DataFrame | None = None
    norms: DataFrame | None = None
    turn = 0
    while True:
        level = write_shared(with_norms(calc(cells), mra))
        w2 = F.aggregate(F.slice("comp_norm", 2, mra.blocks), F.lit(0.0), lambda a, x: a + x * x)
        if prec < 0 and split is None or max_iter == turn:
            done = level if done is None else done.unionByName(level)
            break
        part = level.groupBy("tree_id").agg(F.sum(w2 + (F.pow(F.col("comp_norm")[0], 2) if turn == 0 else 0.0)).alias("t2"))
        norms = write_shared(part if norms is None else norms.union(part).groupBy("tree_id").agg(F.sum("t2").alias("t2")))
        tree_norm = F.lit(1.0) if abs_prec else F.sqrt("t2")
        if split is None:
            test = F.sqrt(w2) * (F.col("tight") if local else 1.0)
            # tight multiplies the norm, as it would divide the precision
            wants = test > threshold(prec, tree_norm, F.col("n"))
        else:
            wants = split
        judged = level.join(norms, "tree_id")
        judged = (local(judged) if local else judged).withColumn("split", wants & (F.col("n") + 2 <= mra.max_scale))
        judged = judged.drop("t2", "tight")
        kept = judged.where("not split").drop("split")
        done = kept if done is None else done.unionByName(kept)
        if finish:
            more = judged.where("split").drop("split").withColumn("is_end", F.lit(False))
            inner = more if inner is None else inner.unionByName(more)
        cells = write_shared(children(judged.where("split").select(*TREE_KEY, *payload), mra.dim).select(*TREE_KEY, *payload))
        turn += 1
        if cells.isEmpty():
            break
    if finish:
        return finish(done if inner is None else done.unionByName(inner))
    return rebuild(done, mra, written=turn == 0)


def start_grid(trees: DataFrame, mra: MRA) -> DataFrame:
    """Root cells of the world for every row of trees (tree_id and whatever goes with it)."""
    cells = root_cells(trees.sparkSession, mra.world).drop("box")
    # the world has as many root cells as its definition says, a handful
    return trees.withColumn("one", F.lit(1)).join(F.broadcast(cells.withColumn("one", F.lit(1))), "one").drop("one")


def hinted_grid(cells: DataFrame, mra: MRA, visible: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], zero: Callable[[np.ndarray, np.ndarray], np.ndarray], scales: int | None = None) -> DataFrame:
    """The leaves (tree_id, n, l..) of the grid that a function's hints call for below the given cells, before any value of it is taken.

    A cell splits where the function isn't visible at its scale and not zero on it: visible(n, low, high) and zero(low, high) are
    asked for many cells at once, n their scales, low and high their corners (cells, D). A task goes on for some scales by itself.
    """
    most = scales or SCALES[mra.dim]
    steps = B.child_steps(mra.dim)
    kinds = "tree_id string, n int, lx int, ly int, lz int, leaf boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            level = pdf[TREE_KEY].reset_index(drop=True)
            for _ in range(most):
                if not len(level) or len(level) > MOST_CELLS:
                    break
                n = level.n.to_numpy()
                side = 2.0 ** -n.astype(float)[:, None] * np.array(mra.world.sf)
                low = level[list(AXES[: mra.dim])].to_numpy(float) * side
                split = ~np.broadcast_to(visible(n, low, low + side), len(level)) & ~np.broadcast_to(zero(low, low + side), len(level)) & (n + 2 <= mra.max_scale)
                yield level[~split].assign(leaf=True)
                inner = np.flatnonzero(split)
                level = level.iloc[np.repeat(inner, mra.blocks)].reset_index(drop=True)
                level["n"] += 1
                for d in range(mra.dim):
                    level[AXES[d]] = 2 * level[AXES[d]] + np.tile(steps[:, d], len(inner))
            yield level.assign(leaf=False)

    done: list[DataFrame] = []
    front = write_shared(cells.select(*TREE_KEY))
    while not front.isEmpty():
        found = write_shared(front.repartition(F.pmod(F.xxhash64(*TREE_KEY), F.lit(1 + front.count() // 2000))).mapInPandas(run, kinds))
        done.append(found.where("leaf").select(*TREE_KEY))
        front = found.where("not leaf").select(*TREE_KEY)
    return reduce(DataFrame.unionByName, done) if done else cells.select(*TREE_KEY)


def project_function(spark: SparkSession, mra: MRA, f: Callable[[np.ndarray], np.ndarray], prec: float, tree_id: str = "f", start: DataFrame | None = None, **options) -> DataFrame:
    """Tree of a vectorised callable f(points[N, D]) -> values[N], from the roots or from start cells of that tree_id, as hinted_grid makes them."""
    cells = start_grid(spark.createDataFrame([(tree_id,)], "tree_id string"), mra) if start is None else start

    def values(pdf: pd.DataFrame, x: np.ndarray) -> np.ndarray:
        return f(x.reshape(-1, mra.dim)).reshape(len(pdf), -1)

    return project(cells, mra, values, prec, **options)


CUT = 60.0  # a Gaussian counts as 0 where its exponent is below minus this


def project_functions(spark: SparkSession, mra: MRA, fs: dict[str, Callable[[np.ndarray], np.ndarray]], prec: float, **options) -> DataFrame:
    """One tree for each callable f(points[N, D]) -> values[N], by name, all in one job."""
    cells = start_grid(spark.createDataFrame([(name,) for name in fs], "tree_id string"), mra)

    def values(pdf: pd.DataFrame, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape[:2])
        for name, rows in pdf.reset_index(drop=True).groupby("tree_id").indices.items():
            out[rows] = np.asarray(fs[name](x[rows].reshape(-1, mra.dim)), float).reshape(len(rows), -1)
        return out

    return project(cells, mra, values, prec, **options)


def gaussian_values(pdf: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    """Values (rows, points) of each row's own Gaussian term at its points (rows, points, D)."""
    pos, alpha, power = (np.stack(pdf[c].to_numpy()).astype(float)[:, None] for c in ("pos", "alpha", "power"))
    r = x - pos
    return pdf["coef"].to_numpy(float)[:, None] * np.prod(np.where(power == 0, 1.0, r**power), axis=2) * np.exp(-np.minimum((alpha * r * r).sum(2), 700.0))


def near_cell(mra: MRA) -> Column:
    """Whether the row's term reaches the row's cell, by the distance of the nearest point."""
    far = []
    for d in range(mra.dim):
        side = F.pow(F.lit(2.0), -F.col("n")) * mra.world.sf[d]
        gap = F.greatest(F.col(AXES[d]) * side - F.col("pos")[d], F.col("pos")[d] - (F.col(AXES[d]) + 1) * side, F.lit(0.0))
        far.append(F.col("alpha")[d] * gap * gap)
    return reduce(lambda a, b: a + b, far) < CUT


PAIRS_AT_ONCE = 4096  # pairs of a cell and a term whose values are held at once
LIGHT = 8192  # pairs of a cell that one task may refine by itself
SHARE = 40_000  # pairs of a task
MOST_CELLS = 20_000  # cells of a level that a task refines further
SCALES = {1: 8, 2: 4, 3: 3}  # scales of a pass, by dimensions


def _values_on(cells: pd.DataFrame, cell: np.ndarray, terms: pd.DataFrame, term: np.ndarray, mra: MRA) -> np.ndarray:
    """Values (cells, points) of the sums of the terms that are paired with the cells.

    The points of a cell are a lattice, on which a term is a product of one factor for each dimension: the sum over a cell's terms is
    one matrix product.
    """
    dim, size = mra.dim, 2 * (mra.k + 1)
    total = np.zeros((len(cells), size**dim))
    pos, alpha, power = (np.stack(terms[c].to_numpy()).astype(float) for c in ("pos", "alpha", "power")) if len(terms) else (np.zeros((0, dim)),) * 3
    coef = terms["coef"].to_numpy(float)
    local = (np.arange(2)[:, None] + B.lattice(1, mra.k)[0].ravel()).ravel() / 2
    l = cells[list(AXES[:dim])].to_numpy(float)
    side = 2.0 ** -cells["n"].to_numpy(float)[:, None]
    order = np.argsort(cell, kind="stable")
    for at in range(0, len(order), PAIRS_AT_ONCE):
        some = order[at : at + PAIRS_AT_ONCE]
        c, t = cell[some], term[some]
        factors = []
        for d in range(dim):
            r = (l[c, d, None] + local) * side[c] * mra.world.sf[d] - pos[t, d, None]
            f = np.exp(-np.minimum(alpha[t, d, None] * r * r, 700.0))
            if power[t, d].any():
                f *= np.where(power[t, d, None] == 0, 1.0, r ** power[t, d, None])
            factors.append(f)
        factors[0] = factors[0] * coef[t, None]
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        for i, j in zip(starts, np.r_[starts[1:], len(c)], strict=True):
            outer = np.ones((j - i, 1))
            for f in factors[:0:-1]:
                outer = (outer[:, :, None] * f[i:j, None, :]).reshape(j - i, -1)
            total[c[i]] += (outer.T @ factors[0][i:j]).ravel()
    # (child, inner) of a dimension side by side, as they lie on its axis; the rows of a node have all children first
    lattice = total.reshape((len(cells),) + (2, mra.k + 1) * dim)
    return lattice.transpose([0, *[1 + 2 * d for d in range(dim)], *[2 + 2 * d for d in range(dim)]]).reshape(len(cells), -1)


def _reaches(cells: pd.DataFrame, cell: np.ndarray, terms: pd.DataFrame, term: np.ndarray, mra: MRA) -> np.ndarray:
    """Whether terms reach the cells they are paired with; near_cell for arrays."""
    pos, alpha = (np.stack(terms[c].to_numpy()).astype(float)[term] for c in ("pos", "alpha"))
    side = 2.0 ** -cells.n.to_numpy(float)[cell][:, None] * np.array(mra.world.sf)
    low = cells[list(AXES[: mra.dim])].to_numpy(float)[cell] * side
    gap = np.maximum(np.maximum(low - pos, pos - low - side), 0)
    return (alpha * gap * gap).sum(1) < CUT


def _refine(cells: pd.DataFrame, pairs: pd.DataFrame, mra: MRA, prec: float, abs_prec: bool, scales: int) -> pd.DataFrame:
    """Some cells (key, t2: the tree's square norm so far) and what becomes of them within so many scales, as rows of REFINED.

    leaf: a cell that stays; open: a cell still to be looked at, with its place in the cells given (f..); norm: what was added to a tree's norm.
    What a tree gains here raises its norm for the rest of the task.
    """
    cells = cells.reset_index(drop=True)
    terms = pairs.reset_index(drop=True)
    index = pd.MultiIndex.from_frame(cells[TREE_KEY])
    cell = index.get_indexer(pd.MultiIndex.from_frame(terms[TREE_KEY])) if len(terms) else np.zeros(0, int)
    term = np.arange(len(terms))
    level = cells.assign(**{f"f{k}": cells[k] for k in KEY})
    trees, of_tree = np.unique(level.tree_id.to_numpy(str), return_inverse=True)
    t2, gained = np.zeros(len(trees)), np.zeros(len(trees))
    t2[of_tree] = level.t2.to_numpy(float)
    columns, out = [*TREE_KEY, *[f"f{k}" for k in KEY]], []
    for turn in range(scales):
        a = from_values(_values_on(level, cell, terms, term, mra), level.n.to_numpy(), mra)
        w2 = (a[:, mra.size :] ** 2).sum(1)
        np.add.at(gained, of_tree, w2)
        n = level.n.to_numpy()
        norm = 1.0 if abs_prec else np.sqrt(t2 + gained)[of_tree]
        split = (np.sqrt(w2) > np.maximum(TWO_E_15, prec * norm * 2.0 ** (-0.5 * (n + 1)))) & (n + 2 <= mra.max_scale)
        out.append(level[columns][~split].assign(kind="leaf", coef=list(a[~split]), gain=0.0))
        inner = np.flatnonzero(split)
        steps = B.child_steps(mra.dim)
        below = level.iloc[np.repeat(inner, mra.blocks)].reset_index(drop=True)
        below["n"] += 1
        for d in range(mra.dim):
            below[AXES[d]] = 2 * below[AXES[d]] + np.tile(steps[:, d], len(inner))
        first = np.full(len(level), -1)
        first[inner] = np.arange(len(inner)) * mra.blocks
        kept = first[cell] >= 0
        cell = (first[cell[kept]][:, None] + np.arange(mra.blocks)).ravel()
        term = np.repeat(term[kept], mra.blocks)
        near = _reaches(below, cell, terms, term, mra) if len(cell) else np.zeros(0, bool)
        cell, term, level, of_tree = cell[near], term[near], below, of_tree[np.repeat(inner, mra.blocks)]
        if not len(level) or len(level) > MOST_CELLS:
            break
    out.append(level[columns].assign(kind="open", coef=None, gain=0.0))
    out.append(pd.DataFrame({"tree_id": trees, "kind": "norm", "coef": None, "gain": gained}))
    return pd.concat(out, ignore_index=True)[[*columns, "kind", "coef", "gain"]].astype({k: "Int32" for k in [*KEY, *[f"f{k}" for k in KEY]]})


REFINED = f"tree_id string, {', '.join(f'{k} int' for k in KEY)}, {', '.join(f'f{k} int' for k in KEY)}, kind string, coef array<double>, gain double"


def project_gaussians(gaussians: DataFrame, mra: MRA, prec: float, start: DataFrame | None = None, max_iter: int = -1, abs_prec: bool = False) -> DataFrame:
    """One tree per fn_id of a Gaussian table, from the roots or from start cells (tree_id, n, l..).

    Cells meet only the terms that reach them: the pairs of the cells that split are handed to the children that the
    term still reaches. A task refines its cells for some scales by itself, with the tree's norm as it was when the pass began and
    what it adds itself, and hands up only cells that are still open. A cell with very many terms goes one scale a pass: its values are
    summed over the pairs in each task, then by cell, so no cell gathers its terms in one task. Like terms are merged before.
    """
    from mwspark.operators.arith import sum_arrays

    terms = write_shared(merged(gaussians)).withColumnRenamed("fn_id", "tree_id")
    own = ["coef", "alpha", "pos", "power"]
    points = mra.blocks * mra.size
    values = "tree_id string, n int, lx int, ly int, lz int, coef array<double>"

    def evaluate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cells = pdf[TREE_KEY].drop_duplicates().reset_index(drop=True)
            cell = pd.MultiIndex.from_frame(cells).get_indexer(pd.MultiIndex.from_frame(pdf[TREE_KEY]))
            yield cells.assign(coef=list(_values_on(cells, cell, pdf, np.arange(len(pdf)), mra)))

    def coefs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield keys_of(pdf).assign(is_end=True, coef=list(from_values(np.stack(pdf["coef"].to_numpy()), pdf.n.to_numpy(), mra)))

    def one_scale(cells: DataFrame, pairs: DataFrame) -> DataFrame:
        zero = cells.select(*TREE_KEY, F.array_repeat(F.lit(0.0), points).alias("coef"))
        sums = sum_arrays(pairs.mapInPandas(evaluate, values).unionByName(zero), TREE_KEY, values, points, cells.count())
        return with_norms(sums.mapInPandas(coefs, NODE), mra)

    grid = start_grid(terms.select("tree_id").distinct(), mra) if start is None else start
    cells = write_shared(grid.select(*TREE_KEY))
    pairs = write_shared(cells.join(terms.select("tree_id", *own), "tree_id").where(near_cell(mra)).select(*TREE_KEY, *own))
    level = write_shared(one_scale(cells, pairs))
    if prec < 0 or max_iter == 0:
        return rebuild(level, mra)
    w2 = F.aggregate(F.slice("comp_norm", 2, mra.blocks), F.lit(0.0), lambda a, x: a + x * x)
    norms = write_shared(level.groupBy("tree_id").agg(F.sum(w2 + F.pow(F.col("comp_norm")[0], 2)).alias("t2")))

    def judged(level: DataFrame) -> DataFrame:
        norm = F.lit(1.0) if abs_prec else F.sqrt("t2")
        return level.join(norms, "tree_id").withColumn("split", (F.sqrt(w2) > threshold(prec, norm, F.col("n"))) & (F.col("n") + 2 <= mra.max_scale))

    done = [judged(level).where("not split").select(*TREE_KEY, "coef")]
    # the front: open cells, each with the cell of the last pass whose pairs it takes
    front = children(judged(level).where("split").select(*TREE_KEY, *[F.col(k).alias(f"f{k}") for k in KEY]), mra.dim)
    front = write_shared(front.select(*TREE_KEY, *[f"f{k}" for k in KEY]))
    left = max_iter - 1

    def paired() -> DataFrame:
        before = pairs.select("tree_id", *[F.col(k).alias(f"f{k}") for k in KEY], *own)
        return write_shared(front.join(before, ["tree_id", *[f"f{k}" for k in KEY]]).where(near_cell(mra)).select(*TREE_KEY, *own))

    while left != 0 and not front.isEmpty():
        scales = SCALES[mra.dim] if max_iter < 0 else min(SCALES[mra.dim], left)
        pairs = paired()
        counts = pairs.groupBy(*TREE_KEY).agg(F.count("*").alias("c"))
        cells = write_shared(front.select(*TREE_KEY).join(counts, TREE_KEY, "left").join(norms, "tree_id").select(*TREE_KEY, "t2", F.coalesce("c", F.lit(0)).alias("c")))
        total, most = cells.agg(F.sum("c"), F.max("c")).first()
        heavy = cells.where(F.col("c") > LIGHT).select(*TREE_KEY) if most > LIGHT else None
        some, light = pairs, cells
        if heavy is not None:
            some, light = pairs.join(heavy, TREE_KEY, "left_anti"), cells.where(F.col("c") <= LIGHT)
        task = F.pmod(F.xxhash64(*TREE_KEY), F.lit(1 + int(total + cells.count()) // SHARE)).alias("task")
        refined = light.select(*TREE_KEY, "t2", task).groupBy("task").cogroup(some.select(*TREE_KEY, *own, task).groupBy("task"))
        refined = write_shared(refined.applyInPandas(lambda c, p: _refine(c, p, mra, prec, abs_prec, scales) if len(c) else pd.DataFrame(columns=[x.split()[0] for x in REFINED.split(", ")]), REFINED))  # noqa: B023
        done.append(refined.where("kind = 'leaf'").select(*TREE_KEY, "coef"))
        opened = refined.where("kind = 'open'").select(*TREE_KEY, *[f"f{k}" for k in KEY])
        gains = [refined.where("kind = 'norm'").select("tree_id", F.col("gain").alias("t2"))]
        if heavy is not None:
            level = write_shared(one_scale(heavy, pairs.join(heavy, TREE_KEY, "left_semi")))
            gains.append(level.groupBy("tree_id").agg(F.sum(w2).alias("t2")))
            done.append(judged(level).where("not split").select(*TREE_KEY, "coef"))
            opened = opened.unionByName(children(judged(level).where("split").select(*TREE_KEY, *[F.col(k).alias(f"f{k}") for k in KEY]), mra.dim).select(*TREE_KEY, *[f"f{k}" for k in KEY]))
        norms = write_shared(reduce(DataFrame.union, [norms, *gains]).groupBy("tree_id").agg(F.sum("t2").alias("t2")))
        front = write_shared(opened)
        left -= scales
    if left == 0 and not front.isEmpty():  # what max_iter leaves open stays as it is
        pairs = paired()
        done.append(one_scale(front.select(*TREE_KEY), pairs).select(*TREE_KEY, "coef"))
    whole = reduce(DataFrame.unionByName, done)
    return rebuild(whole.select(*TREE_KEY, F.lit(True).alias("is_end"), "coef"), mra)


__all__ = ["adaptive", "cell_points", "gaussian_values", "hinted_grid", "project", "project_function", "project_functions", "project_gaussians", "start_grid", "threshold"]

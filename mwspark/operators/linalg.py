"""Linear algebra over sets of functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mwspark.functions.shared import write_shared
from mwspark.functions.trees import stack, wavelet_square, with_norms
from mwspark.mra import MRA, TREE_KEY
from mwspark.operators import arith
from mwspark.operators.keys import ancestors, parent_key
from mwspark.operators.reduce import square_norm
from mwspark.operators.transform import reconstruct_down

CELLS_PER_TASK = 2048
BLOCK = 2048  # functions: a block of a complex or an extended matrix has 64 MB at most
STEPS = 80  # of the iteration for a root
BLOCK_ROW = "a int, b int, rows int, m binary"  # a block of a complex matrix, row by row


def _products(bra: pd.DataFrame, ket: pd.DataFrame, mra: MRA) -> pd.DataFrame:
    """(i, j, re): the inner products of some cells, summed: a matrix product for each cell that both own.

    Sums are extended, and the roots' scaling parts, which are the largest, are multiplied apart: so what is exact stays so.
    """
    width = mra.blocks * mra.size
    i_names, i_at = np.unique(bra.tree_id.to_numpy(str), return_inverse=True)
    j_names, j_at = np.unique(ket.tree_id.to_numpy(str), return_inverse=True)
    total = np.zeros((len(i_names), len(j_names)), np.longdouble)
    met = np.zeros(total.shape, bool)
    own = {cell: rows for cell, rows in ket.reset_index(drop=True).groupby(TREE_KEY[1:]).indices.items()}
    a, b = stack(bra.coef, width), stack(ket.coef, width)
    for cell, rows in bra.reset_index(drop=True).groupby(TREE_KEY[1:]).indices.items():
        cols = own.get(cell)
        if cols is not None:
            at = np.ix_(i_at[rows], j_at[cols])
            if cell[0] == mra.world.scale:
                total[at] += a[rows, : mra.size] @ b[cols, : mra.size].T
            total[at] += a[rows, mra.size :] @ b[cols, mra.size :].T
            met[at] = True
    i, j = np.nonzero(met)
    return pd.DataFrame({"i": i_names[i], "j": j_names[j], "re": total[i, j].astype(float)})


def _tasks(nodes: DataFrame) -> int:
    return 1 + nodes.select(*TREE_KEY[1:]).distinct().count() // CELLS_PER_TASK


def overlap_matrix(nodes: DataFrame, mra: MRA, tasks: int | None = None, block: int | None = None) -> DataFrame:
    """(i, j, re) = <i|j> for all pairs of the set that share cells: the functions that own a cell meet there.

    Functions are dealt to blocks and cells to tasks by hashes. A task sums the products of two blocks in one matrix before it gives
    them up; of blocks i and j only the half with i <= j is made, the other is its mirror image.
    """
    part = _block_products(nodes, nodes, mra, tasks, block, half=True)
    mirrored = part.where("ib < jb").select(F.col("j").alias("i"), F.col("i").alias("j"), "re")
    return part.select("i", "j", "re").unionByName(mirrored).groupBy("i", "j").agg(F.sum("re").alias("re"))


def cross_overlap(bra: DataFrame, ket: DataFrame, mra: MRA, tasks: int | None = None, block: int | None = None) -> DataFrame:
    """(i, j, re) = <bra_i|ket_j>; cells of one side alone add nothing."""
    return _block_products(bra, ket, mra, tasks, block).groupBy("i", "j").agg(F.sum("re").alias("re"))


def _block_products(bra: DataFrame, ket: DataFrame, mra: MRA, tasks: int | None, block: int | None, half: bool = False) -> DataFrame:
    """(i, j, re, ib, jb) partial sums by block of bra functions, block of ket functions and task of cells.

    A side's nodes go once to each block of the other side, so where all functions fit one block they are copied once.
    """
    block = block or BLOCK
    counts = [1 + x.select("tree_id").distinct().count() // block for x in (bra, ket)]
    tasks = tasks or _tasks(bra)
    task = F.pmod(F.xxhash64(*TREE_KEY[1:]), F.lit(tasks)).alias("task")
    of = lambda n: F.pmod(F.xxhash64("tree_id", F.lit(5)), F.lit(n)).cast("int")
    left = bra.select(*TREE_KEY, "coef", task, of(counts[0]).alias("ib"))
    left = left.withColumn("jb", F.explode(F.sequence(F.col("ib") if half else F.lit(0), F.lit(counts[1] - 1))))
    right = ket.select(*[F.col(c).alias(c) for c in [*TREE_KEY, "coef"]], task, of(counts[1]).alias("jb"))
    right = right.withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("jb") if half else F.lit(counts[0] - 1))))
    keys = ["ib", "jb", "task"]

    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _products(a, b, mra).assign(ib=int(key[0]), jb=int(key[1]))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(one, "i string, j string, re double, ib int, jb int")


def _inverse_root(s: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh((s + s.conj().T) / 2)
    held = value > max(1e-14, 1e-13 * value.max(initial=0.0))  # what rounding leaves of a dependent set grows with its overlaps
    inv = np.where(held, 1 / np.sqrt(np.where(held, value, 1)), 0.0)
    return (vector * inv) @ vector.conj().T


def lowdin_matrix(overlap: DataFrame, block: int | None = None) -> DataFrame:
    """S^(-1/2) of a set's overlap (i, j, re[, im]), Hermitian where there is an im.

    Up to block functions one task takes the eigenvalues apart; those below 1e-14, or 1e-13 of the largest, count as 0. More functions are too many for one task: then
    the root is iterated in blocks (Newton and Schulz), for which S must be definite: a set that is linearly dependent raises.
    """
    block = block or BLOCK
    has_im = "im" in overlap.columns
    names = overlap.select("i").union(overlap.select("j")).distinct().withColumn("at", F.row_number().over(Window.orderBy("i")) - 1)  # a row for each function
    names = write_shared(names)
    n = names.count()
    rows = overlap.join(names.withColumnRenamed("at", "x"), "i").join(names.select(F.col("i").alias("j"), F.col("at").alias("y")), "j")
    rows = rows.select("x", "y", "re", (F.col("im") if has_im else F.lit(0.0)).alias("im"))
    dense = rows.groupBy(F.floor(F.col("x") / block).cast("int").alias("a"), F.floor(F.col("y") / block).cast("int").alias("b"))

    def to_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape = [min(block, n - int(k) * block) for k in key]
        m = np.zeros(shape, complex)
        np.add.at(m, (pdf.x.to_numpy() - int(key[0]) * block, pdf.y.to_numpy() - int(key[1]) * block), pdf.re.to_numpy() + 1j * pdf.im.to_numpy())
        return _as_row(*key, m)

    blocks = dense.applyInPandas(to_block, BLOCK_ROW)
    if n <= block:
        root = blocks.mapInPandas(lambda frames: (_as_row(0, 0, _inverse_root(_as_matrix(r))) for f in frames for r in f.itertuples()), BLOCK_ROW)
    else:
        root = _iterated_root(write_shared(blocks), n, block)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                m = _as_matrix(r)
                x, y = np.indices(m.shape)
                for k in range(0, m.size, 200_000):
                    part = slice(k, k + 200_000)
                    yield pd.DataFrame({"x": x.ravel()[part] + r.a * block, "y": y.ravel()[part] + r.b * block, "re": m.real.ravel()[part], "im": m.imag.ravel()[part]})

    out = root.mapInPandas(spread, "x int, y int, re double, im double")
    out = out.join(names.withColumnRenamed("at", "x"), "x").join(names.select(F.col("i").alias("j"), F.col("at").alias("y")), "y")
    return out.select("i", "j", "re", *(["im"] if has_im else []))


def _as_row(a: int, b: int, m: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": [int(a)], "b": [int(b)], "rows": [m.shape[0]], "m": [np.ascontiguousarray(m, np.complex128).tobytes()]})


def _as_matrix(r) -> np.ndarray:
    return np.frombuffer(r.m, np.complex128).reshape(r.rows, -1)


def _matmul(x: DataFrame, y: DataFrame, count: int, then: Callable[[int, int, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The product of two matrices in blocks: pairs of blocks meet in a task each, their products are summed by output block."""
    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = x.select("a", F.col("b").alias("k"), "rows", "m", every.alias("c"))
    right = y.select(F.col("a").alias("k"), F.col("b").alias("c"), "rows", "m", every.alias("a"))

    def one(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "rows": [], "m": []})
        return _as_row(key[0], key[1], _as_matrix(next(p.itertuples())) @ _as_matrix(next(q.itertuples())))

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = sum(_as_matrix(r) for r in pdf.itertuples())
        return _as_row(key[0], key[1], m if then is None else then(int(key[0]), int(key[1]), m))

    products = left.groupBy("a", "c", "k").cogroup(right.groupBy("a", "c", "k")).applyInPandas(one, BLOCK_ROW)
    return products.groupBy("a", "b").applyInPandas(total, BLOCK_ROW)


def _iterated_root(s: DataFrame, n: int, block: int) -> DataFrame:
    """S^(-1/2) in blocks: Y from S / c, Z from 1, T = (3 - Z Y) / 2, Y T and T Z until Z Y is 1."""
    spark, count = s.sparkSession, -(-n // block)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                yield pd.DataFrame({"x": np.arange(r.rows) + r.a * block, "v": np.abs(_as_matrix(r)).sum(1)})

    largest = s.mapInPandas(sums, "x int, v double").groupBy("x").agg(F.sum("v").alias("v")).agg(F.max("v")).first()[0]

    def times(c: float):
        return lambda frames: (_as_row(r.a, r.b, c * _as_matrix(r)) for f in frames for r in f.itertuples())

    ones = spark.range(count).select(F.col("id").cast("int").alias("a"))
    y = write_shared(s.mapInPandas(times(1 / largest), BLOCK_ROW))
    z = write_shared(ones.mapInPandas(lambda frames: (_as_row(a, a, np.eye(min(block, n - a * block))) for f in frames for a in f.a), BLOCK_ROW))
    before = np.inf
    for _ in range(STEPS):
        def half(a: int, b: int, m: np.ndarray) -> np.ndarray:
            return (3 * np.eye(*m.shape) - m) / 2 if a == b else -m / 2

        t = write_shared(_matmul(z, y, count, half))

        def off(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples():
                    m = _as_matrix(r)
                    yield pd.DataFrame({"v": [float((np.abs(m - np.eye(*m.shape) if r.a == r.b else m) ** 2).sum())]})

        left = t.mapInPandas(off, "v double").agg(F.sum("v")).first()[0] ** 0.5
        if left < 1e-11 * n or (left < 1e-6 and left >= before):
            return z.mapInPandas(times(largest**-0.5), BLOCK_ROW)
        y, z, before = write_shared(_matmul(y, t, count)), write_shared(_matmul(t, z, count)), left
    raise ValueError("the overlap's root does not settle: the functions are linearly dependent, or nearly so")


def rotate(nodes: DataFrame, u: DataFrame, mra: MRA, prec: float = -1.0) -> DataFrame:
    """out_j = sum over i of in_i U_ij for a matrix (i, j, re); with prec cut as rotate_terms cuts."""
    terms = u.where("re <> 0").select(F.col("j").alias("out_id"), F.col("i").alias("tree_id"), F.col("re").alias("c"))
    return arith.add(terms, nodes, mra) if prec < 0 else rotate_terms(terms.withColumn("grp", F.col("out_id")), nodes, mra, prec)


def rotate_terms(terms: DataFrame, nodes: DataFrame, mra: MRA, prec: float) -> DataFrame:
    """Sums out_id = sum of c * tree over terms(out_id, grp, tree_id, c), cut where they are small.

    A node has children only where the square norm of its wavelets, over all outputs of its grp, is above prec^2 2^-(n+1), and so is
    that of every node above it; the outputs of a grp share one grid. Wavelets of an output are the sums of the inputs' own,
    cell by cell (a missing node has none); scaling parts follow from the roots.
    """
    j = nodes.select(*TREE_KEY, "coef").join(terms.where("c <> 0").select("out_id", "tree_id", "c"), "tree_id")
    scaled = j.select(F.col("out_id").alias("tree_id"), *TREE_KEY[1:], F.transform("coef", lambda x: x * F.col("c")).alias("coef"))
    sums = arith.sum_arrays(scaled, TREE_KEY, "tree_id string, n int, lx int, ly int, lz int, coef array<double>", mra.blocks * mra.size, nodes.count())
    groups = write_shared(terms.select(F.col("out_id").alias("tree_id"), "grp").distinct())
    sums = write_shared(with_norms(sums, mra).join(groups, "tree_id"))
    cell = ["grp", *TREE_KEY[1:]]
    judged = sums.groupBy(*cell).agg((F.sum(wavelet_square()) > prec**2 * F.pow(F.lit(2.0), -(F.first("n") + 1))).alias("open"))
    judged = write_shared(judged)
    names = {"an": "n", "ax": "lx", "ay": "ly", "az": "lz"}
    above = ancestors(judged.select(*cell), mra.world.scale, itself=False)
    closed = judged.where("not open").select("grp", *[F.col(v).alias(k) for k, v in names.items()])
    gone = above.join(closed, ["grp", *names], "left_semi").select(*cell).distinct()
    kept = write_shared(judged.select(*cell).join(gone, cell, "left_anti"))
    inner = kept.select("grp", *parent_key()).distinct().withColumn("inner", F.lit(True))
    flagged = kept.join(inner, cell, "left").join(groups, "grp").select(*TREE_KEY, F.col("inner").isNull().alias("is_end"))
    zero = F.array_repeat(F.lit(0.0), mra.blocks * mra.size)
    whole = flagged.join(sums.select(*TREE_KEY, "coef"), TREE_KEY, "left").select(*TREE_KEY, "is_end", F.coalesce("coef", zero).alias("coef"))
    return reconstruct_down(whole, mra)


def orthonormalize(nodes: DataFrame, mra: MRA) -> DataFrame:
    """The set in its Loewdin basis."""
    return rotate(nodes, lowdin_matrix(overlap_matrix(nodes, mra)), mra)


def orthogonalize(bra: DataFrame, ket: DataFrame, mra: MRA) -> DataFrame:
    """Every bra without its components along the kets, which are orthogonal to each other."""
    s = cross_overlap(bra, ket, mra)
    norm = square_norm(ket).select(F.col("tree_id").alias("j"), "square_norm")
    own = bra.select(F.col("tree_id").alias("out_id")).distinct().select("out_id", F.concat(F.lit("bra/"), "out_id").alias("tree_id"), F.lit(1.0).alias("c"))
    terms = s.join(norm, "j").select(F.col("i").alias("out_id"), F.concat(F.lit("ket/"), "j").alias("tree_id"), (-F.col("re") / F.col("square_norm")).alias("c"))
    both = bra.withColumn("tree_id", F.concat(F.lit("bra/"), "tree_id")).unionByName(ket.withColumn("tree_id", F.concat(F.lit("ket/"), "tree_id")))
    return arith.add(own.unionByName(terms), both, mra)


__all__ = ["cross_overlap", "lowdin_matrix", "orthogonalize", "orthonormalize", "overlap_matrix", "rotate", "rotate_terms"]

"""Functions of several components, each real or complex, over a table of real trees.

A function is rows (fn_id, comp, part, tree_id, c_re, c_im, conj, label): part "re" or "im" names the tree that holds this part of the
component, c is the component's factor, conj says that the component counts as its conjugate, label its orthogonality label (0: none).
Every operation is a table of terms: sums of real trees or of products of two, with real coefficients; complex arithmetic is only
in those coefficients. Results name their trees fn_id/comp/part and have factor 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.functions.shared import write_shared
from mwspark.mra import MRA, TREE_KEY
from mwspark.operators import arith, derivative, grid, linalg, project, reduce

FUNCTIONS = "fn_id string, comp int, part string, tree_id string, c_re double, c_im double, conj boolean, label int"
NAMES = ["fn_id", "comp", "part", "tree_id", "c_re", "c_im", "conj", "label"]
SMALL = 1e-14  # a term with a smaller squared factor or norm is left out of a sum


def function(spark: SparkSession, fn_id: str, comps: dict[int, tuple[str | None, str | None]], label: int = 0) -> DataFrame:
    """The rows of one function: for each component the trees of its real and imaginary part (None: zero)."""
    rows = [(fn_id, c, part, tree, 1.0, 0.0, False, label) for c, trees in comps.items() for part, tree in zip(("re", "im"), trees, strict=True) if tree is not None]
    return spark.createDataFrame(rows, FUNCTIONS)


def part_of(functions: DataFrame, part: str) -> DataFrame:
    """real_part, imag_part: the part alone, as a real function. Factors and conjugation must have been resolved."""
    return functions.where(F.col("part") == part).withColumn("part", F.lit("re"))


def complex_from(real: DataFrame, imag: DataFrame) -> DataFrame:
    """real + i imag for real functions under the same fn_id and comp."""
    return real.where("part = 're'").unionByName(imag.where("part = 're'").withColumn("part", F.lit("im")))


def conjugate(functions: DataFrame) -> DataFrame:
    """dagger: a flag alone."""
    return functions.withColumn("conj", ~F.col("conj"))


def rescale(functions: DataFrame, c: complex) -> DataFrame:
    """Times c: into the factors alone."""
    re, im = F.col("c_re"), F.col("c_im")
    return functions.withColumns({"c_re": re * c.real - im * c.imag, "c_im": re * c.imag + im * c.real})


def copy(functions: DataFrame, nodes: DataFrame, fn_id: str) -> tuple[DataFrame, DataFrame]:
    """deep_copy: the function's trees under new ids, and its rows."""
    named = functions.withColumn("new", F.concat_ws("/", F.lit(fn_id), F.col("comp").cast("string"), "part"))
    trees = nodes.join(named.select("tree_id", "new").distinct(), "tree_id").drop("tree_id").withColumnRenamed("new", "tree_id").select(nodes.columns)
    return named.withColumn("tree_id", F.col("new")).withColumn("fn_id", F.lit(fn_id)).select(*NAMES), trees


def values_of(functions: DataFrame) -> DataFrame:
    """(fn_id, comp, label, tree_id, re, im): each tree's complex coefficient in its function: factor times 1, i or -i."""
    # the flag conjugates what the trees hold, the factor stays
    i = F.when(F.col("conj"), -1.0).otherwise(1.0)
    im = F.col("part") == "im"
    re_ = F.when(im, -F.col("c_im") * i).otherwise(F.col("c_re"))
    im_ = F.when(im, F.col("c_re") * i).otherwise(F.col("c_im"))
    return functions.select("fn_id", "comp", "label", "tree_id", re_.alias("re"), im_.alias("im"))


def _sum(terms: DataFrame, nodes: DataFrame, mra: MRA, label: int = 0, **options) -> tuple[DataFrame, DataFrame]:
    """Functions and trees from terms (fn_id, comp, tree_id, re, im): complex sums of real trees."""
    parts = terms.select("fn_id", "comp", "tree_id", F.explode(F.array(F.struct(F.lit("re").alias("part"), F.col("re").alias("c")), F.struct(F.lit("im").alias("part"), F.col("im").alias("c")))).alias("x"))
    parts = parts.select("fn_id", "comp", "x.part", "tree_id", "x.c").where("c <> 0")
    out = F.concat_ws("/", "fn_id", F.col("comp").cast("string"), "part").alias("out_id")
    parts = write_shared(parts.select(out, "fn_id", "comp", "part", "tree_id", "c"))
    trees = arith.add(parts.select("out_id", "tree_id", "c"), nodes, mra, **options)
    rows = parts.select("fn_id", "comp", "part", F.col("out_id").alias("tree_id")).distinct()
    return rows.select("*", F.lit(1.0).alias("c_re"), F.lit(0.0).alias("c_im"), F.lit(False).alias("conj"), F.lit(label).alias("label")), trees


def linear_combination(terms: DataFrame, functions: DataFrame, nodes: DataFrame, mra: MRA, prec: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """Sums out_id of (c_re + i c_im) fn_id over terms(out_id, fn_id, c_re, c_im), component by component; vanishing terms are left out."""
    norm = reduce.square_norm(nodes)
    own = values_of(functions).join(norm, "tree_id").where(F.col("square_norm") >= SMALL).drop("square_norm")
    t = terms.select("out_id", "fn_id", F.col("c_re").alias("a"), F.col("c_im").alias("b")).where(F.col("a") * F.col("a") + F.col("b") * F.col("b") >= SMALL)
    j = own.join(t, "fn_id").select(F.col("out_id").alias("fn_id"), "comp", "tree_id", (F.col("re") * F.col("a") - F.col("im") * F.col("b")).alias("re"), (F.col("re") * F.col("b") + F.col("im") * F.col("a")).alias("im"))
    return _sum(j, nodes, mra, prec=prec)


def add(functions: DataFrame, other: DataFrame, nodes: DataFrame, mra: MRA, c: complex = 1.0) -> tuple[DataFrame, DataFrame]:
    """F + c G for functions under the same fn_id, component by component; a component of one alone counts as it is."""
    both = values_of(functions).unionByName(values_of(rescale(other, complex(c))))
    return _sum(both.drop("label"), nodes, mra)


def multiply(pairs: DataFrame, functions: DataFrame, nodes: DataFrame, mra: MRA, prec: float = -1.0, conj_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Products out_id = F G over pairs(out_id, a_id, b_id), component by component; with conj_first of F's conjugate."""
    left = functions if not conj_first else conjugate(functions).withColumn("c_im", -F.col("c_im"))
    a = values_of(left).select(F.col("fn_id").alias("a_id"), "comp", F.col("tree_id").alias("at"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = values_of(functions).select(F.col("fn_id").alias("b_id"), "comp", F.col("tree_id").alias("bt"), F.col("re").alias("br"), F.col("im").alias("bi"))
    j = pairs.join(a, "a_id").join(b, ["b_id", "comp"])
    name = F.concat_ws("*", "at", "bt")
    re = F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")
    im = F.col("ar") * F.col("bi") + F.col("ai") * F.col("br")
    j = write_shared(j.select("out_id", "comp", "at", "bt", name.alias("tree_id"), re.alias("re"), im.alias("im")))
    real = j.select(F.col("tree_id").alias("out_id"), F.col("at").alias("a_id"), F.col("bt").alias("b_id"), F.lit(1.0).alias("c")).distinct()
    products = write_shared(arith.multiply(real, nodes, mra, prec))
    return _sum(j.select(F.col("out_id").alias("fn_id"), "comp", "tree_id", "re", "im"), products, mra)


def density(functions: DataFrame, nodes: DataFrame, mra: MRA, prec: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """conj(F) F of every function, a real function of the same name."""
    pairs = functions.select("fn_id").distinct().select(F.col("fn_id").alias("out_id"), F.col("fn_id").alias("a_id"), F.col("fn_id").alias("b_id"))
    rows, trees = multiply(pairs, functions, nodes, mra, prec, conj_first=True)
    kept = rows.where("part = 're'")
    return kept, trees.join(kept.select("tree_id"), "tree_id", "left_semi")


def dot(pairs: DataFrame, functions: DataFrame, nodes: DataFrame, mra: MRA) -> DataFrame:
    """(a_id, b_id, re, im) = <F|G> over pairs(a_id, b_id): summed over components, 0 where both labels are set and differ."""
    a = values_of(functions).select(F.col("fn_id").alias("a_id"), "comp", F.col("label").alias("la"), F.col("tree_id").alias("bra_id"), F.col("re").alias("ar"), (-F.col("im")).alias("ai"))
    b = values_of(functions).select(F.col("fn_id").alias("b_id"), "comp", F.col("label").alias("lb"), F.col("tree_id").alias("ket_id"), F.col("re").alias("br"), F.col("im").alias("bi"))
    j = pairs.join(a, "a_id").join(b, ["b_id", "comp"])
    allowed = (F.col("la") == F.col("lb")) | (F.col("la") == 0) | (F.col("lb") == 0)
    j = write_shared(j.where(allowed))
    real = reduce.dot_pairs(j.select("bra_id", "ket_id").distinct(), nodes, nodes, mra)
    met = j.join(real, ["bra_id", "ket_id"])
    got = met.groupBy("a_id", "b_id").agg(F.sum((F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")) * F.col("dot")).alias("re"), F.sum((F.col("ar") * F.col("bi") + F.col("ai") * F.col("br")) * F.col("dot")).alias("im"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return pairs.join(got, ["a_id", "b_id"], "left").select("a_id", "b_id", zero("re"), zero("im"))


def square_norm(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fn_id, square_norm): over all components and parts, factors included."""
    weight = F.col("c_re") * F.col("c_re") + F.col("c_im") * F.col("c_im")
    return functions.join(reduce.square_norm(nodes), "tree_id").groupBy("fn_id").agg(F.sum(weight * F.col("square_norm")).alias("square_norm"))


def crop(functions: DataFrame, nodes: DataFrame, mra: MRA, prec: float) -> DataFrame:
    """The trees of all components, pruned."""
    return grid.crop(nodes.join(functions.select("tree_id").distinct(), "tree_id", "left_semi"), mra, prec)


def project_complex(spark: SparkSession, mra: MRA, fs: dict[tuple[str, int], Callable], prec: float, **options) -> tuple[DataFrame, DataFrame]:
    """Functions from callables f(points[N, D]) -> complex values[N], by (fn_id, comp): real and imaginary parts, all in one job."""
    parts: dict[str, Callable] = {}
    rows = []
    for (fn_id, comp), f in fs.items():
        for part in ("re", "im"):
            name = f"{fn_id}/{comp}/{part}"
            parts[name] = _part(f, part)
            rows.append((fn_id, comp, part, name, 1.0, 0.0, False, 0))
    return spark.createDataFrame(rows, FUNCTIONS), project.project_functions(spark, mra, parts, prec, **options)


def _part(f: Callable, part: str) -> Callable:
    return lambda x: f(x).real if part == "re" else f(x).imag


def differentiate(functions: DataFrame, nodes: DataFrame, metric: dict[tuple[int, int], complex], mra: MRA, d: int, a: float = 0.5, b: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """d/dx_d of functions: component o of the result is the sum over i of metric[i, o] times the derivative of component i."""
    spark = nodes.sparkSession
    used = nodes.join(functions.select("tree_id").distinct(), "tree_id", "left_semi")
    done = write_shared(derivative.apply(used, mra, d, a, b))
    table = F.broadcast(spark.createDataFrame([(i, o, complex(c).real, complex(c).imag) for (i, o), c in metric.items()], "comp int, o int, a double, b double"))
    j = values_of(functions).join(table, "comp")
    j = j.select("fn_id", F.col("o").alias("comp"), "tree_id", (F.col("re") * F.col("a") - F.col("im") * F.col("b")).alias("re"), (F.col("re") * F.col("b") + F.col("im") * F.col("a")).alias("im"))
    return _sum(j, done, mra)


def overlap_matrix(functions: DataFrame, nodes: DataFrame, mra: MRA) -> DataFrame:
    """(i, j, re, im) = <i|j> of all functions: the real overlaps of their trees, weighed by factors; 0 between set labels that differ."""
    real = linalg.overlap_matrix(nodes.join(functions.select("tree_id").distinct(), "tree_id", "left_semi").select(*TREE_KEY, "coef"), mra)
    return _weighed(real, functions, functions)


def cross_overlap(bra: DataFrame, ket: DataFrame, nodes: DataFrame, mra: MRA) -> DataFrame:
    """(i, j, re, im) = <bra_i|ket_j> of two sets of functions over one table of trees."""
    of = lambda f: nodes.join(f.select("tree_id").distinct(), "tree_id", "left_semi").select(*TREE_KEY, "coef")
    return _weighed(linalg.cross_overlap(of(bra), of(ket), mra), bra, ket)


def _weighed(real: DataFrame, bra: DataFrame, ket: DataFrame) -> DataFrame:
    v, w = values_of(bra), values_of(ket)
    a = v.select(F.col("fn_id").alias("fi"), F.col("comp").alias("ca"), F.col("label").alias("la"), F.col("tree_id").alias("i"), F.col("re").alias("ar"), (-F.col("im")).alias("ai"))
    b = w.select(F.col("fn_id").alias("fj"), F.col("comp").alias("cb"), F.col("label").alias("lb"), F.col("tree_id").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    allowed: Column = (F.col("la") == F.col("lb")) | (F.col("la") == 0) | (F.col("lb") == 0)
    j = real.withColumnRenamed("re", "s").join(a, "i").join(b, "j").where((F.col("ca") == F.col("cb")) & allowed)
    return j.groupBy(F.col("fi").alias("i"), F.col("fj").alias("j")).agg(F.sum((F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")) * F.col("s")).alias("re"), F.sum((F.col("ar") * F.col("bi") + F.col("ai") * F.col("br")) * F.col("s")).alias("im"))


def rotate(functions: DataFrame, u: DataFrame, nodes: DataFrame, mra: MRA, prec: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """Functions j = sum over i of U_ij function i for a complex matrix (i, j, re, im), component by component.

    With prec the real and the imaginary part of a component are cut together, by the sum of their wavelets' square norms.
    """
    t = u.where("re <> 0 or im <> 0").select(F.col("i").alias("fn_id"), F.col("j").alias("out"), F.col("re").alias("a"), F.col("im").alias("b"))
    j = values_of(functions).join(t, "fn_id")
    j = j.select(F.col("out").alias("fn_id"), "comp", "tree_id", (F.col("re") * F.col("a") - F.col("im") * F.col("b")).alias("re"), (F.col("re") * F.col("b") + F.col("im") * F.col("a")).alias("im"))
    if prec < 0:
        return _sum(j, nodes, mra)
    parts = j.select("fn_id", "comp", "tree_id", F.explode(F.array(F.struct(F.lit("re").alias("part"), F.col("re").alias("c")), F.struct(F.lit("im").alias("part"), F.col("im").alias("c")))).alias("x"))
    grp = F.concat_ws("/", "fn_id", F.col("comp").cast("string"))
    parts = write_shared(parts.where("x.c <> 0").select("fn_id", "comp", "x.part", grp.alias("grp"), F.concat_ws("/", grp, F.col("x.part")).alias("out_id"), "tree_id", "x.c"))
    trees = linalg.rotate_terms(parts.groupBy("out_id", "grp", "tree_id").agg(F.sum("c").alias("c")), nodes, mra, prec)
    rows = parts.select("fn_id", "comp", "part", F.col("out_id").alias("tree_id")).distinct()
    return rows.select("*", F.lit(1.0).alias("c_re"), F.lit(0.0).alias("c_im"), F.lit(False).alias("conj"), F.lit(0).alias("label")), trees


def orthonormalize(functions: DataFrame, nodes: DataFrame, mra: MRA, prec: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """The set in its Loewdin basis: rotated by the inverse root of its Hermitian overlap."""
    return rotate(functions, write_shared(linalg.lowdin_matrix(write_shared(overlap_matrix(functions, nodes, mra)))), nodes, mra, prec)


def orthogonalize(bra: DataFrame, ket: DataFrame, nodes: DataFrame, mra: MRA) -> tuple[DataFrame, DataFrame]:
    """Every bra function without its components along the ket functions, which are orthogonal to each other: bra - sum of <ket|bra> / <ket|ket> ket."""
    s = cross_overlap(ket, bra, nodes, mra)
    norm = square_norm(ket, nodes).select(F.col("fn_id").alias("i"), "square_norm").where(F.col("square_norm") > 0)
    t = s.join(norm, "i").select(F.col("j").alias("out"), F.col("i").alias("fn_id"), (-F.col("re") / F.col("square_norm")).alias("a"), (-F.col("im") / F.col("square_norm")).alias("b"))
    j = values_of(ket).join(t, "fn_id").select(F.col("out").alias("fn_id"), "comp", "tree_id", (F.col("re") * F.col("a") - F.col("im") * F.col("b")).alias("re"), (F.col("re") * F.col("b") + F.col("im") * F.col("a")).alias("im"))
    return _sum(values_of(bra).select("fn_id", "comp", "tree_id", "re", "im").unionByName(j), nodes, mra)

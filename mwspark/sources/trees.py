"""Saving and loading trees, Gaussian tables and samples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.functions.basis import child_steps, values_to_coefs
from mwspark.functions.gaussians import ROW
from mwspark.functions.shared import write_shared
from mwspark.functions.trees import stack, with_norms
from mwspark.mra import AXES, MRA, TREE_KEY
from mwspark.operators.keys import children, end_nodes, parent_key
from mwspark.operators.transform import SCALING, compress_up, to_values


def save_trees(nodes: DataFrame, path: str, buckets: int = 16) -> None:
    """One Parquet folder per bucket of tree ids, nodes in key order inside each file."""
    out = nodes.select(*TREE_KEY, "is_end", "coef").withColumn("tree_bucket", F.pmod(F.xxhash64("tree_id"), F.lit(buckets)).cast("int"))
    out.repartition("tree_bucket", F.pmod(F.xxhash64(*TREE_KEY), F.lit(8))).sortWithinPartitions(*TREE_KEY).write.partitionBy("tree_bucket").parquet(path)


def load_trees(spark: SparkSession, path: str, mra: MRA, tree_ids: list[str] | None = None) -> DataFrame:
    """Trees with end flags and norms computed anew."""
    nodes = spark.read.parquet(path).drop("tree_bucket", "is_end")
    if tree_ids is not None:
        nodes = nodes.where(F.col("tree_id").isin(tree_ids))
    ends = end_nodes(nodes).select(*TREE_KEY, F.lit(True).alias("is_end"))
    flagged = nodes.join(ends, TREE_KEY, "left").select(*TREE_KEY, F.coalesce("is_end", F.lit(False)).alias("is_end"), "coef")
    return with_norms(flagged, mra)


def read_gaussians(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(path)


def write_samples(points: DataFrame, path: str) -> None:
    points.write.option("header", True).csv(path)


TEXT_BYTES = 16 << 20  # of a file of text


def export_leaf_text(nodes: DataFrame, mra: MRA, path: str, cells_a_file: int | None = None) -> None:
    """Text exchange of trees, a folder for each: the dimension, the world's bounds, points a side, how many cells, then for each child
    of a leaf a line "scale l.." counted from the world's corner and a line of its values, x slowest and all axes from the last point.

    A large tree is several files, each a text of its own with header and count, so that no task writes or reads more than a bounded
    part; a tree of no more than cells_a_file leaves (by default about TEXT_BYTES of text) is one file. Worlds are cubes from -L to L.
    """
    dim, k1 = mra.dim, mra.k + 1
    if mra.world.corner != (-1,) * dim or mra.world.boxes != (2,) * dim:
        raise ValueError("the text form takes worlds from -L to L only")
    root, half = mra.world.scale, 2.0**-mra.world.scale
    order = np.arange(k1**dim).reshape((k1,) * dim).transpose(*range(dim)[::-1])[(slice(None, None, -1),) * dim].ravel()

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = child_steps(dim)
        for pdf in frames:
            if not len(pdf):
                continue
            n = pdf.n.to_numpy()
            v = to_values(stack(pdf.coef, mra.blocks * mra.size), n, mra).reshape(len(pdf), mra.blocks, -1)
            out = []
            for i, (tree, part) in enumerate(zip(pdf.tree_id, pdf.part, strict=True)):
                first = 2 * (pdf[list(AXES[:dim])].iloc[i].to_numpy(np.int64) + int(2.0 ** n[i] * half))
                for c in range(mra.blocks):
                    at = " ".join(map(str, [n[i] - root + 2, *(first + steps[c])]))
                    out.append((tree, part, at + "\n" + " ".join(f"{x:.17g}" for x in v[i, c][order])))
            yield pd.DataFrame(out, columns=["tree_id", "part", "value"])

    most = cells_a_file or max(1, TEXT_BYTES // (25 * mra.blocks * mra.size))
    ends = nodes.where("is_end").select(*TREE_KEY, "coef")
    parts = ends.groupBy("tree_id").agg((1 + F.floor((F.count("*") - 1) / most)).cast("int").alias("parts"))
    ends = ends.join(parts, "tree_id").withColumn("part", F.pmod(F.xxhash64(*TREE_KEY), F.col("parts")).cast("int"))
    body = ends.select(*TREE_KEY, "coef", "part").mapInPandas(cells, "tree_id string, part int, value string").withColumn("rank", F.lit(1))
    bounds = "\n".join(f"{-half * s:.14g} {half * s:.14g}" for s in mra.world.sf)
    head = ends.groupBy("tree_id", "part").agg(F.count("*").alias("c")).select("tree_id", "part", F.concat(F.lit(f"{dim}\n{bounds}\n{k1}\n"), (F.col("c") * mra.blocks).cast("string")).alias("value"), F.lit(0).alias("rank"))
    lines = body.unionByName(head).repartition("tree_id", "part").sortWithinPartitions("tree_id", "part", "rank")
    lines.select("tree_id", "part", "value").write.partitionBy("tree_id", "part").text(path)


def import_leaf_text(spark: SparkSession, path: str, mra: MRA) -> DataFrame:
    """Trees from the text form: siblings make a leaf, missing ones count as zero, and the leaves' ancestors are built up to the roots."""
    dim, k1 = mra.dim, mra.k + 1
    root, half = mra.world.scale, 2.0**-mra.world.scale
    order = np.arange(k1**dim).reshape((k1,) * dim).transpose(*range(dim)[::-1])[(slice(None, None, -1),) * dim].ravel()
    files = spark.read.schema("value string, tree_id string, part int").option("basePath", path).text(f"{path}/tree_id=*", wholetext=True)  # files are bounded by the writer
    lines = F.filter(F.split("value", "\n"), lambda x: x != "")
    files = files.select("tree_id", lines.alias("lines"))
    line = lambda i: F.trim(F.element_at("lines", i))
    bounds = [F.abs(F.split(line(2 + d), " +")[1].cast("double") - half * mra.world.sf[d]) > 1e-9 for d in range(dim)]
    odd = files.where((F.col("lines")[0] != str(dim)) | (line(dim + 2) != str(k1)) | reduce(lambda a, b: a | b, bounds) | (2 * line(dim + 3).cast("int") != F.size("lines") - dim - 3))
    if not odd.isEmpty():
        raise ValueError("the text's world or order is not that of the analysis, or cells are missing from it")
    # after the header a cell is two lines, one after the other
    start = dim + 3
    pairs = F.transform(F.sequence(F.lit(0), ((F.size("lines") - start) / 2).cast("int") - 1), lambda i: F.struct(F.element_at("lines", (2 * i + start + 1).cast("int")).alias("at"), F.element_at("lines", (2 * i + start + 2).cast("int")).alias("values")))
    cells = files.where(F.size("lines") > start).select("tree_id", F.explode(pairs).alias("c")).select("tree_id", "c.at", "c.values")
    at = F.split(F.trim("at"), " +")
    n = (at[0].cast("int") + root - 1).alias("n")
    keys = [(at[d + 1].cast("long") - F.pow(F.lit(2.0), at[0].cast("int") + root - 1).cast("long") * int(half)).cast("int").alias(a) if d < dim else F.lit(0).alias(a) for d, a in enumerate(AXES)]
    child = cells.select("tree_id", n, *keys, F.transform(F.split(F.trim("values"), " +"), lambda x: x.cast("double")).alias("v"))

    def scaling(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        back = np.argsort(order)
        for pdf in frames:
            if len(pdf):
                v = stack(pdf.v, mra.size)[:, back]
                yield pdf[TREE_KEY].assign(s=list(values_to_coefs(v, dim, mra.k, mra.basis, pdf.n.to_numpy(), mra.world.volume_factor)))

    inner = compress_up(child.mapInPandas(scaling, SCALING), mra)
    nodes = write_shared(inner.select(*TREE_KEY, "coef"))
    # siblings of a deep node that the text left out are leaves of zeros
    inner_keys = nodes.select("tree_id", *parent_key()).where(F.col("n") >= root).distinct()
    zero = F.array_repeat(F.lit(0.0), mra.blocks * mra.size)
    missing = children(inner_keys, dim).select(*TREE_KEY).join(nodes.select(*TREE_KEY), TREE_KEY, "left_anti").select(*TREE_KEY, zero.alias("coef"))
    whole = write_shared(nodes.unionByName(missing))
    ends = end_nodes(whole.select(*TREE_KEY)).select(*TREE_KEY, F.lit(True).alias("is_end"))
    flagged = whole.join(ends, TREE_KEY, "left").select(*TREE_KEY, F.coalesce("is_end", F.lit(False)).alias("is_end"), "coef")
    return with_norms(flagged, mra)

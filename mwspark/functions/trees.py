"""Pieces that tree operators share: the node schema, norms as columns, shared tables and vectorised maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.functions.shared import write_shared
from mwspark.mra import KEY, MRA, TREE_KEY

KEYS = "tree_id string, n int, lx int, ly int, lz int"
NODE = f"{KEYS}, is_end boolean, coef array<double>"


def stack(arrays: pd.Series, width: int) -> np.ndarray:
    return np.concatenate(arrays.to_numpy()).reshape(len(arrays), -1).astype(float) if len(arrays) else np.zeros((0, width))


def map_coefs(df: DataFrame, schema: str, fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], width: int, col: str = "coef") -> DataFrame:
    """fn(rows, coefficient matrix) on Arrow batches of node rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield fn(pdf, stack(pdf[col], width))

    return df.mapInPandas(run, schema)


def keys_of(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[TREE_KEY].reset_index(drop=True)


def with_norms(nodes: DataFrame, mra: MRA) -> DataFrame:
    """Adds comp_norm (one norm for each block) and sq_norm, with built-in functions."""
    size = mra.size
    norm = lambda c: F.sqrt(F.aggregate(F.slice("coef", c * size + 1, F.lit(size)), F.lit(0.0), lambda a, x: a + x * x))
    comp = F.transform(F.sequence(F.lit(0), F.lit(mra.blocks - 1)), norm)
    return nodes.withColumn("comp_norm", comp).withColumn("sq_norm", F.aggregate("comp_norm", F.lit(0.0), lambda a, x: a + x * x))


def wavelet_square(col: str = "comp_norm") -> Column:
    return F.aggregate(F.slice(col, 2, F.size(col)), F.lit(0.0), lambda a, x: a + x * x)


def scaling_block(mra: MRA) -> Column:
    return F.slice("coef", 1, mra.size)


def grid_of(nodes: DataFrame) -> DataFrame:
    return nodes.select(*TREE_KEY)


def no_nodes(spark: SparkSession, schema: str = NODE) -> DataFrame:
    return spark.createDataFrame([], schema)


__all__ = ["KEY", "KEYS", "NODE", "TREE_KEY", "grid_of", "keys_of", "map_coefs", "no_nodes", "scaling_block", "stack", "wavelet_square", "with_norms", "write_shared"]

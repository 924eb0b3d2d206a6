"""Convolution kernels as tables of one-dimensional terms: rows (oper_id, term, coef, beta, power).

A kernel is the sum over its terms of coef * prod over d of (x_d^power exp(-beta x_d^2)).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

KERNEL = "oper_id string, term int, coef double, beta double, power int"
# fixed values: the step of the trapezoidal rules by precision, the growth of a search for a range, the largest rank
STEP, GROWTH, MOST_TERMS = (0.2, 0.47), 1.1, 1000


def _rule(low: float, high: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights of a trapezoidal rule of relative precision eps, end weights halved."""
    step = 1 / (STEP[0] - STEP[1] * np.log10(eps))
    n = int(np.ceil((high - low) / step)) + 1
    if n > MOST_TERMS:
        raise ValueError(f"{n} terms are more than {MOST_TERMS}")
    weight = np.full(n, step)
    weight[[0, -1]] /= 2
    return low + step * np.arange(n), weight


def _first(fails, start: float = 1.0) -> float:
    """The first of start, start * GROWTH, .. for which fails is false."""
    x = start
    while fails(x):
        x *= GROWTH
    return x


def poisson(eps: float, r_min: float, r_max: float) -> tuple[np.ndarray, np.ndarray]:
    """(coef, beta) of 1/r on [r_min, r_max]: 1/r = 2/sqrt(pi) times the integral of exp(-r^2 u^2) over u > 0, with u = 2 log(1 + exp(sinh s))."""
    ratio = r_min / r_max
    wide = _first(lambda t: 2 * t * np.exp(-t) > eps)
    sharp = _first(lambda t: np.sqrt(t) * np.exp(-t) / ratio > eps)
    s, w = _rule(-np.log(2 * wide), np.log(sharp / ratio**2) / 2, eps)
    u = 2 * np.logaddexp(0, np.sinh(s))
    slope = 2 * np.cosh(s) / (1 + np.exp(-np.sinh(s)))
    return w * 2 / np.sqrt(np.pi) * slope / r_max, (u / r_max) ** 2


def helmholtz(mu: float, eps: float, r_min: float, r_max: float) -> tuple[np.ndarray, np.ndarray]:
    """(coef, beta) of exp(-mu r)/r on [r_min, r_max]: 2/sqrt(pi) times the integral of exp(-r^2 e^(2s) - mu^2 e^(-2s) / 4 + s) over s."""
    reach = max(-2.5 * np.log(eps), 5.0)
    m = mu * r_max
    s, w = _rule(-np.log(4 * reach / m**2) / 2, np.log(reach * (r_max / r_min) ** 2) / 2, eps)
    return w * 2 / np.sqrt(np.pi) * np.exp(s - m**2 / 4 * np.exp(-2 * s)) / r_max, np.exp(2 * s) / r_max**2


def heat(t: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(coef, beta) of the heat kernel at time t: a normalised Gaussian of exponent 1 / (4t)."""
    return np.array([(0.25 / t / np.pi) ** (dim / 2)]), np.array([0.25 / t])


def identity(eps: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(coef, beta) of a normalised Gaussian of exponent eps^(-1/2): nearly a delta function."""
    beta = eps**-0.5
    return np.array([(beta / np.pi) ** (dim / 2)]), np.array([beta])


def derivative(eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(coef, beta) of x exp(-x^2 / eps) (power 1): the derivative of a one-dimensional normalised Gaussian."""
    return np.array([-2 / eps / np.sqrt(eps * np.pi)]), np.array([1 / eps])


def rows(oper_id: str, terms: tuple[np.ndarray, np.ndarray], power: int = 0) -> pd.DataFrame:
    coef, beta = terms
    return pd.DataFrame({"oper_id": oper_id, "term": np.arange(len(coef), dtype="int32"), "coef": coef, "beta": beta, "power": np.full(len(coef), power, "int32")})


def table(spark: SparkSession, *kernels: pd.DataFrame) -> DataFrame:
    """A kernel table: some tens to some hundreds of rows a kernel, by construction."""
    return spark.createDataFrame(pd.concat(kernels, ignore_index=True), KERNEL)

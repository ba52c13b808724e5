"""Special functions of the moderated test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def digamma(x: Column) -> Column:
    """Shift the argument up by 8, then the asymptotic series; about 1e-13 accurate for x > 0."""
    y = x + 8
    step = sum((1 / (x + i) for i in range(1, 8)), 1 / x)
    inv2 = 1 / (y * y)
    series = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 * (1 / 132)))))
    return F.log(y) - 0.5 / y - series - step


def trigamma(x: Column) -> Column:
    y = x + 8
    step = sum((1 / ((x + i) * (x + i)) for i in range(1, 8)), 1 / (x * x))
    inv, inv2 = 1 / y, 1 / (y * y)
    series = inv * inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 * (1 / 30 - inv2 * (5 / 66)))))
    return inv + 0.5 * inv2 + series + step


def digamma_of(x: float) -> float:
    y, step = x, 0.0
    while y < 10:
        step += 1 / y
        y += 1
    i2 = 1 / (y * y)
    return math.log(y) - 0.5 / y - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132)))) - step


def polygamma_of(x: float) -> tuple[float, float]:
    """(trigamma, tetragamma) of x > 0."""
    y, tri, tetra = x, 0.0, 0.0
    while y < 10:
        tri += 1 / y**2
        tetra -= 2 / y**3
        y += 1
    i, i2 = 1 / y, 1 / (y * y)
    tri += i + 0.5 * i2 + i * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 * (1 / 30 - i2 * 5 / 66))))
    tetra += -i2 - i * i2 - i2 * i2 * (1 / 2 - i2 * (1 / 6 - i2 * (1 / 6 - i2 * (3 / 10 - i2 * 5 / 6))))
    return tri, tetra


def inverse_trigamma(value: float) -> float:
    """Solve trigamma(y) = value for y > 0 by Newton on the reciprocal, which is nearly linear."""
    if value > 1e7:
        return 1 / math.sqrt(value)
    if value < 1e-6:
        return 1 / value
    y = 0.5 + 1 / value
    for _ in range(60):
        tri, tetra = polygamma_of(y)
        step = tri * (1 - tri / value) / tetra
        y += step
        if abs(step) <= 1e-12 * y:
            break
    return y


def t_upper_tail_of(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for Student's t, through the incomplete beta function (Lentz's continued fraction)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    finite = np.isfinite(df)
    nu = np.where(finite, df, 1.0)
    x = nu / (nu + t * t)
    flip = x > (nu / 2 + 1) / (nu / 2 + 2.5)
    a = np.where(flip, 0.5, nu / 2)
    b = np.where(flip, nu / 2, 0.5)
    z = np.where(flip, 1 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(z) + b * np.log1p(-z)) / a
        front = np.where(z <= 0, 0.0, front)
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1 - (a + b) * z / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (
                m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
    beta = front * h
    two_sided = np.where(flip, 1 - beta, beta)
    half = np.where(t >= 0, two_sided / 2, 1 - two_sided / 2)
    normal = 0.5 * np.vectorize(math.erfc, otypes=[float])(t / math.sqrt(2))
    return np.where(finite, half, normal)


@F.pandas_udf(DoubleType())
def t_upper_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = (t.notna() & df.notna()).to_numpy()
    out = np.full(len(t), np.nan)
    out[ok] = t_upper_tail_of(t.to_numpy()[ok], df.to_numpy()[ok])
    return pd.Series(out).where(ok, None)

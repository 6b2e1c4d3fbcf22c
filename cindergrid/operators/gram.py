"""Least squares and ridge regression from second moments: one scan, whatever the number of penalties and folds.

Per fold one aggregation gives the number of rows, the means and all covariances of terms and label (updated around
running means, so large means cost no digits). Everything else, every fit of every fold and the errors on the rows
held out, follows from these small matrices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.operators.sampling import with_fold

# Penalties tried by ridge regression.
RIDGE_ALPHAS = [10.0**e for e in range(-6, 7)]


@dataclass
class Moments:
    """Number of rows, means and summed squares and products around the means; the label comes last."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        off = other.mean - self.mean
        return Moments(n, self.mean + off * other.n / n, self.cross + other.cross + np.outer(off, off) * self.n * other.n / n)

    def fit(self, alpha: float = 0.0) -> tuple[float, np.ndarray]:
        """Intercept and coefficients; ``alpha`` times their squares is added to the summed squared error. Of equally
        good solutions, as with constant or repeated terms, the shortest."""
        a, b = self.cross[:-1, :-1] + alpha * np.eye(len(self.mean) - 1), self.cross[:-1, -1]
        # Equal diagonals, so that terms of different size lose no digits.
        scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        w = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-13)[0] / scale
        return float(self.mean[-1] - w @ self.mean[:-1]), w

    def squared_error(self, intercept: float, w: np.ndarray) -> float:
        """Summed over the rows."""
        v = np.append(-w, 1.0)
        return float(v @ self.cross @ v + self.n * (v @ self.mean - intercept) ** 2)


@dataclass
class LinearFit:
    intercept: float
    coefficients: np.ndarray
    terms: list[Column]
    alpha: float = 0.0

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, reduce(Column.__add__, [t * float(w) for t, w in zip(self.terms, self.coefficients)], F.lit(self.intercept)))


def columns(df: DataFrame, features: Sequence[str] | str) -> list[Column]:
    """Numeric columns, or the entries of one array column."""
    if isinstance(features, str):
        first = df.select(F.size(features)).first()
        return [F.col(f"`{features}`")[i].cast("double") for i in range(first[0] if first else 0)]
    return [F.col(f"`{c}`").cast("double") for c in features]


def polynomial(terms: Sequence[Column], degree: int) -> list[Column]:
    """All products of ``terms`` up to ``degree``, by rising power of the last term, without the constant: x, x2, y, xy, y2."""
    def build(j: int, left: int) -> list[Column | None]:
        if j < 0:
            return [None]
        out, power = [], None
        for e in range(left + 1):
            out += [power if t is None else t if power is None else t * power for t in build(j - 1, left - e)]
            power = terms[j] if power is None else power * terms[j]
        return out

    return build(len(terms) - 1, degree)[1:]


def moments(df: DataFrame, terms: Sequence[Column], label: str, by: str | None = None) -> dict[int, Moments]:
    """Moments per value of ``by`` (few), over the rows whose terms and label are all known."""
    names = [f"_t{i}" for i in range(len(terms) + 1)]
    known = [F.nanvl(t.cast("double"), F.lit(None).cast("double")).alias(n) for t, n in zip([*terms, F.col(f"`{label}`")], names)]
    rows = df.select(*([F.col(by).alias("_by")] if by else [F.lit(0).alias("_by")]), *known).dropna("any", subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = rows.groupBy("_by").agg(F.count("*").alias("n"), *[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)],
                                    *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in found:
        cross = np.zeros((len(names), len(names)))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = r[f"c{i}_{j}"] * r.n
        out[r["_by"]] = Moments(r.n, np.array([r[f"m{i}"] for i in range(len(names))]), cross)
    return out


def least_squares(df: DataFrame, features: Sequence[str] | str, label: str, degree: int = 1) -> LinearFit:
    """Least squares on the features, or on their products up to ``degree``."""
    terms = polynomial(columns(df, features), degree)
    found = moments(df, terms, label)
    if not found:
        raise ValueError("no complete rows to learn from")
    return LinearFit(*found[0].fit(), terms)


def ridge(df: DataFrame, features: Sequence[str] | str, label: str, keys: Sequence[str],
          alphas: Sequence[float] = tuple(RIDGE_ALPHAS), folds: int = 5, seed: int = 42, degree: int = 1) -> LinearFit:
    """Ridge regression; the penalty has the least root mean squared error, averaged over the folds (the first of several).

    ``alphas`` multiply the summed squared coefficients beside the summed squared error. The intercept is not penalised."""
    terms = polynomial(columns(df, features), degree)
    parts = moments(with_fold(df, keys, folds, seed, "_fold"), terms, label, "_fold")
    if not parts:
        raise ValueError("no complete rows to learn from")
    whole = reduce(Moments.__add__, parts.values())

    def error(alpha: float) -> float:
        """Average over the folds with rows; a fold that holds all rows has nothing to learn from and is left out."""
        each = []
        for fold, held in parts.items():
            rest = [m for f, m in parts.items() if f != fold]
            if rest:
                each.append(np.sqrt(max(held.squared_error(*reduce(Moments.__add__, rest).fit(alpha)), 0.0) / held.n))
        return float(np.mean(each)) if each else 0.0

    best = min(alphas, key=error)
    return LinearFit(*whole.fit(best), terms, best)

"""Regression from additive sufficient statistics: Spark sums Gram matrices, the driver solves small systems."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, x: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """Sums of products of (1, x..., y): one row, or one a group; columns ``g_i_j`` with i <= j."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    full = [c for c in [*x, y]]
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in full))
    sums = [F.sum(cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)


def as_matrix(row, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"g_{i}_{j}"] or 0.0
    return out


def ols(df: DataFrame, x: list[str], y: str) -> np.ndarray:
    """Coefficients, intercept first (least norm where columns depend on each other)."""
    g = as_matrix(gram(df, x, y).first(), len(x) + 2)
    return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-12)[0]


def linear_predictor(x: list[str], beta: np.ndarray) -> Column:
    out: Column = F.lit(float(beta[0]))
    for c, b in zip(x, beta[1:]):
        out = out + F.col(c) * float(b)
    return out


def residuals(df: DataFrame, x: list[str], y: str, name: str = "resid") -> DataFrame:
    return df.withColumn(name, F.col(y) - linear_predictor(x, ols(df, x, y)))


def hc3_t(df: DataFrame, x: list[str], y: str) -> pd.DataFrame:
    """Coefficients with heteroscedasticity-consistent (HC3) t values; two passes over the rows."""
    names = ["(intercept)", *x]
    g = as_matrix(gram(df, x, y).first(), len(x) + 2)
    inv = np.linalg.inv(g[:-1, :-1])
    beta = inv @ g[:-1, -1]
    row = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    h: Column = F.lit(0.0)
    for i in range(len(row)):
        for j in range(len(row)):
            h = h + row[i] * row[j] * float(inv[i, j])
    e = (F.col(y) - linear_predictor(x, beta)) / (1.0 - h)
    meat = as_matrix(df.select(*x, y, (e * e).alias("_e")).agg(*[F.sum(row[i] * row[j] * F.col("_e")).alias(f"g_{i}_{j}") for i in range(len(row)) for j in range(i, len(row))]).first(), len(row))
    se = np.sqrt(np.diag(inv @ meat @ inv))
    return pd.DataFrame({"term": names, "beta": beta, "se": se, "t": beta / se})


def spline_basis(x: Column, knots: list[float]) -> list[Column]:
    """Natural cubic spline terms (linear term first) for given knots."""

    def cubic(c: Column, k: float) -> Column:
        return F.pow(F.greatest(c - k, F.lit(0.0)), F.lit(3.0))

    def d(k: int) -> Column:
        return (cubic(x, knots[k]) - cubic(x, knots[-1])) / (knots[-1] - knots[k])

    return [x, *[d(k) - d(len(knots) - 2) for k in range(len(knots) - 2)]]


def ridge(df: DataFrame, x: list[str], y: str, penalties: list[float]) -> dict[float, np.ndarray]:
    """Coefficients at each penalty from one Gram matrix; the intercept is not penalised."""
    return _ridge_from(as_matrix(gram(df, x, y).first(), len(x) + 2), penalties)


def _ridge_from(g: np.ndarray, penalties: list[float]) -> dict[float, np.ndarray]:
    free = np.eye(len(g) - 1)
    free[0, 0] = 0
    return {p: np.linalg.solve(g[:-1, :-1] + p * free, g[:-1, -1]) for p in penalties}


def elastic_net(g: np.ndarray, penalty: float, share: float, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Coordinate descent on a Gram matrix: penalty * (share |b| + (1 - share) b^2 / 2) per row; intercept free."""
    n, k = g[0, 0], len(g) - 1
    a, b = g[:-1, :-1] / n, g[:-1, -1] / n
    beta = np.zeros(k)
    for _ in range(rounds):
        before = beta.copy()
        for j in range(k):
            r = b[j] - a[j] @ beta + a[j, j] * beta[j]
            beta[j] = r / a[j, j] if j == 0 else np.sign(r) * max(abs(r) - penalty * share, 0) / (a[j, j] + penalty * (1 - share))
        if np.abs(beta - before).max() < tolerance:
            break
    return beta


def cross_validated(df: DataFrame, x: list[str], y: str, fold: str, penalties: list[float]) -> pd.DataFrame:
    """Held-out error of ridge at each penalty: fold Gram matrices are subtracted from their total.

    One pass over the rows gives everything: errors of held-out rows are quadratic forms
    of their fold's Gram matrix.
    """
    parts = {r[fold]: as_matrix(r, len(x) + 2) for r in gram(df, x, y, [fold]).collect()}
    total = sum(parts.values())
    rows = []
    for f, g in parts.items():
        for p, beta in _ridge_from(total - g, penalties).items():
            v = np.append(-beta, 1.0)
            rows.append({"fold": f, "penalty": p, "n": g[0, 0], "sse": float(v @ g @ v)})
    return pd.DataFrame(rows)


def one_standard_error(errors: pd.DataFrame) -> float:
    """The largest penalty whose mean error is within one standard error of the least."""
    per = errors.assign(mse=errors.sse / errors.n).groupby("penalty").mse.agg(["mean", "sem"])
    best = per["mean"].idxmin()
    return float(per.index[per["mean"] <= per.loc[best, "mean"] + per.loc[best, "sem"]].max())


def pooled_gain(df: DataFrame, base: list[str], extra: list[str], y: str, fold: str, penalty: float) -> float:
    """Out-of-fold R2 of base and extra columns over that of the base alone."""
    out = []
    for x in (base, [*base, *extra]):
        errors = cross_validated(df, x, y, fold, [penalty])
        g = as_matrix(gram(df, x, y).first(), len(x) + 2)
        sst = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
        out.append(1 - errors.sse.sum() / sst)
    return out[1] - out[0]


def logistic(df: DataFrame, x: list[str], y: str, penalty: float = 0.0, rounds: int = 25) -> np.ndarray:
    """Penalised logistic coefficients by Newton steps; each step is one aggregate over the rows."""
    row = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    k = len(row)
    beta = np.zeros(k)
    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-linear_predictor(x, beta)))
        rows = df.select(*x, y, p.alias("_p"))
        w = F.col("_p") * (1.0 - F.col("_p"))
        sums = rows.agg(*[F.sum(row[i] * row[j] * w).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(row[i] * (F.col("_p") - F.col(y))).alias(f"d_{i}") for i in range(k)]).first()
        free = np.eye(k) * penalty
        free[0, 0] = 0
        step = np.linalg.solve(as_matrix(sums, k) + free + 1e-10 * np.eye(k), np.array([sums[f"d_{i}"] for i in range(k)]) + free @ beta)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def calibrated(df: DataFrame, p: str, y: str, name: str = "calibrated") -> DataFrame:
    """expit(a + b logit(p)) with a and b fitted to the outcome."""
    clean = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    rows = df.withColumn("_l", F.log(clean / (1.0 - clean)))
    beta = logistic(rows, ["_l"], y)
    return rows.withColumn(name, 1.0 / (1.0 + F.exp(-(float(beta[0]) + float(beta[1]) * F.col("_l"))))).drop("_l")

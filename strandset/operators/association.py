"""Burden sums, score tests, p-value combination, inflation, agreement and ranking metrics."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import CHI2_MEDIAN_1DF, chi2_sf, erfc_exact, normal_sf
from .aggregates import correlation, mutual_information
from .joins import dealt_sides, pairs_within
from .ranking import linear_quantiles, value_ranks
from .scan import quantile_bucket, running, settle


def weighted_burden(dosage: DataFrame, members: DataFrame, variant: str, group: str, person: str, ds: str, weight: str) -> DataFrame:
    """Sum of weight times dosage of a group's variants for each person who carries any."""
    return dosage.join(members.select(variant, group, weight), variant).groupBy(group, person).agg(F.sum(F.col(weight) * F.col(ds)).alias("burden"), F.count("*").alias("n_carried"))


def score_statistic(burden: DataFrame, residuals: DataFrame, group: str, person: str, value: str = "burden", resid: str = "resid") -> DataFrame:
    """T = sum of standardised burden times residual over *all* persons.

    Persons without a carried variant have burden zero: means and deviations use the number
    of residuals, and as T = (sum(b r) - mean(b) sum(r)) / sd(b) only present rows are joined.
    """
    people = residuals.agg(F.count("*").alias("n"), F.sum(resid).alias("sum_r"))
    per = burden.join(residuals.select(person, resid), person).groupBy(group).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.sum(F.col(value) * F.col(resid)).alias("br"))
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    out = per.crossJoin(F.broadcast(people))
    return out.select(group, mean.alias("mean_burden"), sd.alias("sd_burden"), F.when(sd > 0, (F.col("br") - mean * F.col("sum_r")) / sd).alias("t"))


def single_variant_z(dosage: DataFrame, residuals: DataFrame, variant: str, person: str, ds: str, resid: str = "resid") -> DataFrame:
    """z = U / sqrt(V) of each variant, with zero dosage for persons without a row."""
    people = residuals.agg(F.count("*").alias("n"), F.sum(resid).alias("sr"), F.sum(F.col(resid) * F.col(resid)).alias("srr"))
    per = dosage.join(residuals.select(person, resid), person).groupBy(variant).agg(F.sum(ds).alias("s"), F.sum(F.col(ds) * F.col(ds)).alias("q"), F.sum(F.col(ds) * F.col(resid)).alias("u0"))
    mean, var = F.col("s") / F.col("n"), F.col("srr") / F.col("n") - F.pow(F.col("sr") / F.col("n"), F.lit(2))
    u = F.col("u0") - mean * F.col("sr")
    v = (F.col("q") - F.col("n") * mean * mean) * var
    return per.crossJoin(F.broadcast(people)).select(variant, u.alias("u"), v.alias("v"), F.when(v > 0, u / F.sqrt(v)).alias("z"))


def burden_test(stats: DataFrame, covariance: DataFrame, group: str, variant: str, u: str = "u", weight: str = "w", mean: str | None = None) -> DataFrame:
    """Chi-square (1 df) of (w'U)^2 / (w'Sw) with its p; ``covariance`` is (group, a, b, s) with both orders.

    A pair absent from ``covariance`` counts as zero or, where ``mean`` names the column of
    mean over deviation, as minus the product of its two means: the covariance of variants
    without a shared carrier.  That part has rank one, so its pairs are never made.
    """
    m = F.col(mean) if mean else F.lit(0.0)
    wu = stats.groupBy(group).agg(F.sum(F.col(weight) * F.col(u)).alias("wu"), F.sum(F.col(weight) * m).alias("wm"))
    w = stats.select(group, variant, F.col(weight).alias("_w"), m.alias("_m"))
    a = w.select(group, F.col(variant).alias("a"), F.col("_w").alias("_wa"), F.col("_m").alias("_ma"))
    b = w.select(group, F.col(variant).alias("b"), F.col("_w").alias("_wb"), F.col("_m").alias("_mb"))
    term = F.col("_wa") * F.col("_wb") * (F.col("s") + F.col("_ma") * F.col("_mb"))
    quad = covariance.join(a, [group, "a"]).join(b, [group, "b"]).groupBy(group).agg(F.sum(term).alias("shared"))
    wsw = F.col("shared") - F.col("wm") * F.col("wm")
    chi2 = F.when(wsw > 0, F.col("wu") * F.col("wu") / wsw)
    return wu.join(quad, group).select(group, chi2.alias("chi2"), chi2_sf(chi2, 1).alias("p"))


def _liu_tail(q: float, lam: np.ndarray, taken: np.ndarray | None = None, at: np.ndarray | None = None) -> float:
    """Tail of a weighted sum of chi-squares by matching four moments.

    With weights that are not negative the squared skewness never exceeds the kurtosis, so
    the matched variable is a central chi-square with the kurtosis's degrees of freedom.
    """
    at = lam if at is None else at
    z = np.zeros_like(at) if taken is None else taken
    zz, zlz, zllz = float(z.sum()), float((z * at).sum()), float((z * at**2).sum())
    c1, c2 = float(lam.sum()) - zz, float((lam**2).sum()) - 2 * zlz + zz**2
    c4 = float((lam**4).sum()) - 4 * float((z * at**3).sum()) + 4 * zz * zllz + 2 * zlz**2 - 4 * zz**2 * zlz + zz**4
    if c2 <= 0:
        return 1.0
    df = c2**2 / c4
    x = (q - c1) / math.sqrt(2 * c2) * math.sqrt(2 * df) + df
    return _gammaq(df / 2, max(x, 0.0) / 2)


#: Products of nodes and eigenvalues that the inversion of a tail holds at a time.
TAIL_CELLS = 1_000_000


def _largest(lam: np.ndarray, taken: np.ndarray, at: np.ndarray | None = None) -> float:
    """The largest eigenvalue of a diagonal matrix less zz', ``taken`` being the squares of z: a root between the two largest."""
    at = lam if at is None else at
    order = np.argsort(lam)
    low, high = (float(lam[order[-2]]) if len(lam) > 1 else 0.0), float(lam[order[-1]])
    top = int(np.argmax(at))
    if not taken[top] > 0 or at[top] < high * (1 - 1e-9):
        return high
    for _ in range(200):
        middle = 0.5 * (low + high)
        if not low < middle < high:
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            low, high = (middle, high) if 1 - float((taken / (at - middle)).sum()) > 0 else (low, middle)
    return high


def _krylov(multiply: Callable[[np.ndarray], np.ndarray], z: np.ndarray, steps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """``at, taken``: a few points whose sums of taken * f(at) are z'f(A)z, by Lanczos' steps from z (exact in as many steps as A has eigenvalues)."""
    size = float(np.linalg.norm(z))
    if not size > 0:
        return np.zeros(0), np.zeros(0)
    basis, along, across = [z / size], [], []
    while True:
        y = multiply(basis[-1])
        along.append(float(basis[-1] @ y))
        known = np.array(basis)
        for _ in range(2):  # the second time takes away what rounding left
            y = y - known.T @ (known @ y)
        norm = float(np.linalg.norm(y))
        if len(along) == min(steps, len(z)) or norm <= 1e-13 * max(map(abs, along)):
            break
        across.append(norm)
        basis.append(y / norm)
    at, vectors = np.linalg.eigh(np.diag(along) + np.diag(across, 1) + np.diag(across, -1))
    return at, (size * vectors[0]) ** 2


def _inverted_tail(q: float, lam: np.ndarray, tolerance: float = 1e-9, taken: np.ndarray | None = None, at: np.ndarray | None = None) -> tuple[float, float]:
    """Tail of a weighted sum of chi-squares (1 df each, positive weights) and its relative error.

    P(Q > q) is the integral of exp(K(s) - q s) / s over a contour that crosses the real axis
    between the pole at 0 and the first branch point 1 / (2 max(lam)), K being the cumulant
    generating function.  The contour is a parabola around the branch cut through (about) the
    saddle point, where the integrand falls like a Gaussian and nothing cancels, so small
    tails come with the same relative accuracy as large ones.  Below the mean it crosses left
    of the pole and gives the other tail.  The trapezoid rule converges geometrically there;
    its step is halved until two sums agree.

    ``taken`` (squares of z in the eigenvectors' basis) takes zz' away from the matrix of ``lam``:
    its determinant gets one factor, h(s) = 1 + 2 s sum(z^2 / (1 - 2 lam s)), so the eigenvalues
    of the difference are not needed.  Above the real axis no factor meets the logarithm's cut.
    ``at`` are the points of ``taken`` (:func:`_krylov`), where they are not the eigenvalues.
    """
    lam = np.asarray(lam, float)
    z = None if taken is None or not np.any(taken) else np.asarray(taken, float)
    at = lam if at is None else np.asarray(at, float)
    squares = float((lam**2).sum()) - (0.0 if z is None else 2 * float((z * at).sum()) - float(z.sum()) ** 2)
    first, sd = 0.5 / (lam.max() if z is None else _largest(lam, z, at)), math.sqrt(2.0 * squares)

    def slope(s: float) -> float:
        own = float((lam / (1 - 2 * lam * s)).sum()) - q
        f = 1 - 2 * at * s
        return own if z is None else own - float((z / f**2).sum()) / (1 + 2 * s * float((z / f).sum()))

    def log_determinant(s: np.ndarray) -> np.ndarray:
        out, inner = np.zeros(len(s), complex), np.zeros(len(s), complex)
        step = max(1, TAIL_CELLS // max(1, len(s)))
        for k in range(0, len(lam), step):
            out += np.log(1 - 2 * np.outer(s, lam[k : k + step])).sum(1)
        if z is not None:
            for k in range(0, len(at), step):
                inner += (z[k : k + step] / (1 - 2 * np.outer(s, at[k : k + step]))).sum(1)
            out += np.log(1 + 2 * s * inner)
        return np.where(s.imag == 0, out.real, out)  # the determinant is positive on the axis

    # the saddle point by bisection: the slope of the exponent grows from -q to infinity
    low, high = -0.5 * len(lam) / max(q, 1e-300), first * (1 - 1e-15)
    while slope(low) > 0:
        low *= 2
    for _ in range(200):
        middle = 0.5 * (low + high)
        low, high = (middle, high) if slope(middle) < 0 else (low, middle)
    away = min(1.0 / sd, 0.5 * first)
    c = max(low, away) if low >= 0 else min(low, -away)
    width = min(abs(c), first - c)
    # many equal weights make the integrand nearly normal along a straight line; few ones need the bend to fall
    bend = min(0.5, 1.0 / (q * width))
    limit = math.sqrt(45.0 / (q * width * bend))

    def summed(step: float, offset: float) -> float:
        t = np.arange(offset, limit, step)
        s = c + width * (1j * t + bend * t * t)
        exponent = -0.5 * log_determinant(s) - q * s
        value = np.exp(exponent - top) * (1j + 2 * bend * t) * width / s
        weight = np.where(t == 0, 0.5, 1.0)
        return float((weight * value.imag).sum()) * step

    top = float(-0.5 * (np.log1p(-2 * c * lam).sum() if z is None else log_determinant(np.array([c + 0j]))[0].real) - q * c)
    step = 0.25
    total = summed(step, 0.0)
    for _ in range(8):
        step /= 2
        new = total / 2 + summed(2 * step, step) / 2
        error, total = abs(new - total), new
        if error <= tolerance * abs(total):
            break
    part = total / math.pi * math.exp(top)
    p = part if c > 0 else 1.0 + part
    return p, error / max(abs(total), 1e-300) * abs(part) / max(abs(p), 1e-300)


def mixture_tail(q: float, lam: np.ndarray, mode: str = "exact", taken: np.ndarray | None = None, at: np.ndarray | None = None) -> float:
    """``exact`` (inversion on a contour) or ``liu`` (four moments, only fair in the far tail); ``taken`` and ``at`` as in :func:`_inverted_tail`."""
    lam = np.asarray(lam, float)
    taken = None if taken is None else np.asarray(taken, float)[lam > 0] if at is None else np.asarray(taken, float)
    lam = lam[lam > 0]
    if not len(lam):
        return 1.0
    if q <= 0:
        return 1.0
    if mode == "liu":
        return _liu_tail(q, lam, taken, at)
    p, error = _inverted_tail(q, lam, taken=taken, at=at)
    if error > 1e-3 or not 0 <= p <= 1:
        raise ValueError(f"the tail at {q} did not converge")
    return p


def _gammaq(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function by its series and continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        for _ in range(1000):
            k += 1
            term *= x / k
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def skat(stats: DataFrame, covariance: DataFrame, group: str, variant: str, u: str = "u", weight: str = "w", mean: str | None = None, tail: str = "exact") -> DataFrame:
    """Q = sum of (wU)^2 and its tail (:func:`mixture_tail`) from the eigenvalues of the weighted covariance; one group a task.

    Pairs absent from ``covariance`` are as in :func:`burden_test`.
    """
    m = F.col(mean) if mean else F.lit(0.0)
    w = stats.select(group, variant, weight, u, m.alias("_m"))
    cells = covariance.join(w.select(group, F.col(variant).alias("a"), F.col(weight).alias("_wa")), [group, "a"]).join(w.select(group, F.col(variant).alias("b"), F.col(weight).alias("_wb")), [group, "b"])
    cells = cells.select(group, F.lit(1).alias("kind"), F.col("a").cast("string").alias("i"), F.col("b").cast("string").alias("j"), (F.col("_wa") * F.col("_wb") * F.col("s")).alias("x"))
    own = w.select(group, F.lit(0).alias("kind"), F.col(variant).cast("string").alias("i"), F.lit(None).cast("string").alias("j"), F.pow(F.col(weight) * F.col(u), F.lit(2)).alias("x"))
    means = w.select(group, F.lit(2).alias("kind"), F.col(variant).cast("string").alias("i"), F.lit(None).cast("string").alias("j"), (F.col(weight) * F.col("_m")).alias("x"))
    kind = stats.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf.x[pdf.kind == 0].sum()
        wm = pdf[pdf.kind == 2].set_index("i").x.sort_index()
        cov = -np.outer(wm, wm)
        shared = pdf[(pdf.kind == 1) & pdf.x.notna()]
        cov[wm.index.get_indexer(shared.i), wm.index.get_indexer(shared.j)] = shared.x
        lam = np.linalg.eigvalsh(cov) if len(cov) else np.zeros(0)
        lam = lam[lam > 1e-12 * max(1.0, lam.max(initial=0))]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "q": [q], "p": [mixture_tail(q, lam, tail) if len(lam) else 1.0]})

    return cells.unionByName(own).unionByName(means).groupBy(group).applyInPandas(one, f"{group} {kind}, q double, p double")


def acat(p: Column, weight: Column | None = None, low: float = 1e-15, high: float = 1 - 1e-15) -> Column:
    """Cauchy combination of p-values, as an aggregate."""
    x = F.tan((0.5 - F.least(F.greatest(p, F.lit(low)), F.lit(high))) * math.pi)
    mean = F.avg(x) if weight is None else F.sum(weight * x) / F.sum(F.when(p.isNotNull(), weight))
    return 0.5 - F.atan(mean) / math.pi


def omnibus(tests: DataFrame, group: list[str], p: str) -> DataFrame:
    """Cauchy combination over annotation, weight and test rows of each group."""
    return tests.groupBy(*group).agg(acat(F.col(p)).alias("p_omnibus"), F.count(p).alias("n_tests"))


def omnibus_grid(stats: DataFrame, covariance: DataFrame, group: str, variant: str, u: str, weights: dict[str, Column], mean: str | None = None, tail: str = "exact", tests: tuple[str, ...] = ("burden", "skat")) -> DataFrame:
    """``group, weight, test, p`` of every weighting (annotation times density) and test, for :func:`omnibus`."""
    out = []
    for name, w in weights.items():
        weighted = stats.withColumn("_weight", w)
        for test in tests:
            p = burden_test(weighted, covariance, group, variant, u, "_weight", mean) if test == "burden" else skat(weighted, covariance, group, variant, u, "_weight", mean, tail)
            out.append(p.select(group, F.lit(name).alias("weight"), F.lit(test).alias("test"), "p"))
    return reduce(DataFrame.unionByName, out)


#: Pairs of a person's variants that are expanded at a time.
EXPANDED_PAIRS = 2_000_000


def set_products(rows: DataFrame, group: str, variant: str, person: str, ds: str, resid: str | None = None) -> DataFrame:
    """``group, a, b, xy`` (a <= b): sums of products of dosages over the persons, for pairs of a group with a shared carrier.

    Rows are dealt by group and person, so a large group is many tasks' work; each task adds
    up the products of its persons before anything is shuffled again.  With ``resid`` the
    pairs of a variant with itself also carry its sums of dosages and of dosage times residual, ``s`` and ``u``.
    """
    kinds = rows.schema
    sums = ["xy", "s", "u"] if resid else ["xy"]
    schema = f"`{group}` {kinds[group].dataType.simpleString()}, a {kinds[variant].dataType.simpleString()}, b {kinds[variant].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in sums)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        g, v, x = (pdf[c].to_numpy() for c in (group, variant, ds))
        r = x * pdf[resid].to_numpy() if resid else None
        other = np.concatenate([[True], g[1:] != g[:-1]])
        of, names = np.cumsum(other) - 1, g[other]
        new = other | np.concatenate([[True], pdf[person].to_numpy()[1:] != pdf[person].to_numpy()[:-1]])
        ends = np.append(np.flatnonzero(new), len(pdf))
        upto = np.repeat(ends[1:], np.diff(ends))
        size = upto - np.arange(len(pdf))
        out = []
        cuts = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < len(pdf):
            stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + EXPANDED_PAIRS, "right")) - 1)
            a = np.repeat(np.arange(at, stop), size[at:stop])
            b = a + np.arange(len(a)) - np.repeat(cuts[at:stop] - cuts[at], size[at:stop])
            part = {group: of[a], "a": v[a], "b": v[b], "xy": x[a] * x[b]}
            part |= {"s": np.where(a == b, x[a], 0.0), "u": np.where(a == b, r[a], 0.0)} if resid else {}
            out.append(pd.DataFrame(part).groupby([group, "a", "b"], sort=False, as_index=False)[sums].sum())
            at = stop
        total = out[0] if len(out) == 1 else pd.concat(out).groupby([group, "a", "b"], sort=False, as_index=False)[sums].sum()
        total[group] = names[total[group].to_numpy()]
        return total

    def run(frames):
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[group] == pdf[group].iloc[-1]) & (pdf[person] == pdf[person].iloc[-1]) if len(pdf) else None
            if last is None:
                continue
            held = pdf[last]  # its person may go on in the next batch
            if not last.all():
                yield pairs(pdf[~last])
        if held is not None and len(held):
            yield pairs(held)

    cols = [group, person, variant, F.col(ds).cast("double").alias(ds)] + ([resid] if resid else [])
    dealt = rows.select(*cols).repartition(group, person).sortWithinPartitions(group, person, variant)
    # dealt by the first variant, not summed up again before: what a task could add up, it has
    return dealt.mapInPandas(run, schema).repartition(group, "a").groupBy(group, "a", "b").agg(*[F.sum(c).alias(c) for c in sums])


#: Variants of a group whose matrix is taken whole; a larger group falls apart into variants that share carriers.
WHOLE_VARIANTS = 2000

#: Variants of blocks that are small, which are taken together up to about this number.
SMALL_VARIANTS = 200

#: Variants of a block whose eigenvectors are taken; of a larger one only eigenvalues, and its means by Lanczos' steps.
KRYLOV_VARIANTS = 300

#: Links of a group of which a task makes a forest at a time.
FOREST_LINKS = 1_000_000


def _set_rows(dosage: DataFrame, members: DataFrame, residuals: DataFrame, group: str, variant: str, person: str, ds: str, resid: str) -> DataFrame:
    rows = dosage.select(variant, person, ds).join(members.select(variant, group), variant).join(residuals.select(person, resid), person)
    return rows.select(group, variant, person, F.col(ds).cast("double").alias(ds), resid)


def _set_people(residuals: DataFrame, resid: str) -> tuple[int, float, float]:
    """Number, sum and variance of the residuals."""
    people = residuals.agg(F.count(resid).alias("n"), F.sum(resid).alias("sum"), F.sum(F.col(resid) * F.col(resid)).alias("squares")).first()
    n, total = people["n"], people["sum"] or 0.0
    return n, total, ((people["squares"] or 0.0) - total * total / n) / n if n else 0.0


def _set_variants(rows: DataFrame, members: DataFrame, group: str, variant: str, ds: str, weights: list[str], resid: str) -> DataFrame:
    x = F.col(ds)
    sums = rows.groupBy(group, variant).agg(F.sum(x).alias("_s"), F.sum(x * F.col(resid)).alias("_u"), F.sum(x * x).alias("_g"))
    return sums.join(members.select(group, variant, *[F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias(w) for w in weights]), [group, variant])


def _set_statistics(rows: DataFrame, stats: DataFrame, members: DataFrame, people: tuple[int, float, float], group: str, variant: str, person: str, ds: str, weights: list[str]) -> DataFrame:
    n, total, variance = people
    u = F.col("_u") - F.col("_s") * F.lit(total / n if n else 0.0)
    w = [F.col(c) for c in weights]
    name = lambda kind: [f"_{kind}{k}" for k in range(len(w))]
    per = stats.groupBy(group).agg(
        F.count("*").alias("n_variants"),
        *[F.sum(c * F.col("_s")).alias(k) for c, k in zip(w, name("s"))],
        *[F.sum(c * u).alias(k) for c, k in zip(w, name("u"))],
        *[F.sum(F.pow(c * u, F.lit(2))).alias(k) for c, k in zip(w, name("q"))],
        *[F.sum(c * c * F.col("_g")).alias(k) for c, k in zip(w, name("g"))],
    )
    weighted = rows.join(members.select(group, variant, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in weights]), [group, variant])
    burden = weighted.groupBy(group, person).agg(*[F.sum(c * F.col(ds)).alias(k) for c, k in zip(w, name("b"))])
    per = per.join(burden.groupBy(group).agg(*[F.sum(F.col(k) * F.col(k)).alias(k) for k in name("b")]), group)
    cell = lambda kind, k: F.col(f"_{kind}{k}")
    each = [F.struct(F.lit(c).alias("weight"), cell("u", k).alias("_wu"), cell("q", k).alias("q"), cell("g", k).alias("_g"), (variance * (cell("b", k) - cell("s", k) * cell("s", k) / n)).alias("_wsw")) for k, c in enumerate(weights)]
    out = per.select(group, "n_variants", F.explode(F.array(*each)).alias("_e")).select(group, "n_variants", "_e.*")
    chi2 = F.when(F.col("_wsw") > 1e-12 * variance * F.col("_g"), F.col("_wu") * F.col("_wu") / F.col("_wsw"))
    return out.select(group, "n_variants", "weight", chi2.alias("chi2"), erfc_exact(F.sqrt(chi2 / 2)).alias("p_burden"), "q")


def set_statistics(dosage: DataFrame, members: DataFrame, residuals: DataFrame, group: str, variant: str, person: str, ds: str, weights: list[str], resid: str = "resid") -> DataFrame:
    """``group, n_variants, weight, chi2, p_burden, q`` of :func:`set_tests`, for which no matrix is needed.

    The variance of a burden is that of the persons' weighted sums, so a group's rows are
    only added up, by variant and by person.
    """
    rows = settle(_set_rows(dosage, members, residuals, group, variant, person, ds, resid))
    stats = _set_variants(rows, members, group, variant, ds, weights, resid)
    return _set_statistics(rows, stats, members, _set_people(residuals, resid), group, variant, person, ds, weights)


def _least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is linked to."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def shared_blocks(products: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """``group, variant, _block``: the least variant that a variant is linked to by ``group, a, b`` (none: no row).

    A task makes a forest of about a million links of a group (``sizes``: ``group, n_links``), which has
    fewer links than variants; the forests of a group then meet in one task.
    """
    kinds = products.schema[group].dataType.simpleString(), products.schema["a"].dataType.simpleString()

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(np.concatenate([pdf.a, pdf.b]), sort=True)
        least = _least_linked(codes[: len(pdf)], codes[len(pdf) :], len(names))
        return pd.DataFrame({group: pdf[group].iloc[0], "a": names, "b": names[least]})

    linked = products.where((F.col("a") != F.col("b")) & (F.col("xy") != 0)).select(group, "a", "b")
    parts = sizes.select(group, F.ceil(F.col("n_links") / FOREST_LINKS).alias("_parts"))
    dealt = linked.join(F.broadcast(parts), group).withColumn("_part", F.pmod(F.xxhash64("a"), F.col("_parts")))
    few = dealt.select(group, "_part", "a", "b").groupBy(group, "_part").applyInPandas(forest, f"`{group}` {kinds[0]}, a {kinds[1]}, b {kinds[1]}")
    found = few.groupBy(group).applyInPandas(forest, f"`{group}` {kinds[0]}, a {kinds[1]}, b {kinds[1]}")
    return found.select(group, F.col("a").alias("variant"), F.col("b").alias("_block"))


def _block_spectrum(i: np.ndarray, j: np.ndarray, x: np.ndarray, z: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lam, at, taken``: eigenvalues of the symmetric matrix of cells ``i, j, x``, and z for :func:`_inverted_tail`; ``whole`` takes zz' away here.

    One matrix is held, besides the copy that its eigenvalues take.
    """
    matrix = np.zeros((len(z), len(z)))
    matrix[i, j] = matrix[j, i] = x
    if whole:
        matrix -= np.outer(z, z)
        return np.linalg.eigvalsh(matrix), np.zeros(0), np.zeros(0)
    if len(z) <= KRYLOV_VARIANTS:
        lam, vectors = np.linalg.eigh(matrix)
        return lam, lam, (vectors.T @ z) ** 2
    at, taken = _krylov(lambda v: matrix @ v, z)
    return np.linalg.eigvalsh(matrix), at, taken


def set_tests(dosage: DataFrame, members: DataFrame, residuals: DataFrame, group: str, variant: str, person: str, ds: str, weights: list[str], resid: str = "resid", tail: str = "exact", standard: str | None = None) -> DataFrame:
    """``group, n_variants, weight, chi2, p_burden, q, p_kernel``: both tests of each group under every weighting.

    ``members`` (group, variant, weight columns) carries one column a weighting (annotation
    times allele-frequency density); ``standard`` names a further one, one over the deviation
    of each variant's score.  U = X'r without the mean, and the covariance is the
    residuals' variance times X'X without the means.  X'X falls apart into blocks of variants
    that share carriers, one a task; the means take one rank away, by the determinant
    (:func:`_inverted_tail`), so no matrix of a large group is made.  A weighting without variance
    gives NULL.  Persons without a row have dosage zero; groups without a row give none.
    The dosages are read once: all sums come from the products of pairs.
    """
    n, total, variance = _set_people(residuals, resid)
    rows = _set_rows(dosage, members, residuals, group, variant, person, ds, resid)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in (ds, resid)})
    products = settle(set_products(rows, group, variant, person, ds, resid))
    itself = lambda c: F.sum(F.when(F.col("a") == F.col("b"), F.col(c)))
    sums = products.groupBy(group, "a").agg(itself("s").alias("_s"), itself("u").alias("_u"), itself("xy").alias("_g"), F.count("*").alias("_links"))
    sums = sums.select(F.col(group).alias(group), F.col("a").alias(variant), "_s", "_u", "_g", "_links")
    stats = sums.join(members.select(group, variant, *[F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias(w) for w in weights]), [group, variant])
    if standard:
        v = (F.col("_g") - F.col("_s") * F.col("_s") / n) * F.lit(variance)
        stats, weights = stats.withColumn(standard, F.when(v > 0, 1.0 / F.sqrt(v)).otherwise(0.0)), [*weights, standard]
    stats = settle(stats)
    sizes = settle(stats.groupBy(group).agg(F.count("*").alias("n_variants"), F.min(variant).alias("_first"), F.sum("_links").alias("n_links")))
    own = stats.drop("_links").join(F.broadcast(sizes.drop("n_links")), group)
    large = sizes.where(F.col("n_variants") > WHOLE_VARIANTS)
    if large.isEmpty():
        own = own.withColumns({"_block": F.col("_first"), "_part": F.lit(-1).cast("long")})
    else:
        blocks = settle(shared_blocks(products.join(F.broadcast(large.select(group)), group, "left_semi"), large, group).withColumnRenamed("variant", variant))
        many = blocks.groupBy(group, "_block").count().where(F.col("count") > SMALL_VARIANTS).select(group, "_block", F.lit(True).alias("_many"))
        apart = F.col("n_variants") > WHOLE_VARIANTS
        own = own.join(blocks.join(many, [group, "_block"], "left"), [group, variant], "left")
        # small blocks share tasks, by their least variant
        small = apart & F.col("_many").isNull()
        part = F.pmod(F.xxhash64(F.coalesce("_block", variant)), F.ceil(F.col("n_variants") / SMALL_VARIANTS))
        own = own.withColumn("_part", F.when(small, part).otherwise(F.lit(-1)).cast("long")).withColumn("_block", F.when(apart & F.col("_many"), F.col("_block")).otherwise(F.col("_first"))).drop("_many")
        own = settle(own)
    of = own.select(F.col(group).alias("_group"), F.col(variant).alias("_a"), F.col("_block").alias("_of"), F.col("_part").alias("_of_part"))
    cells = products.join(of, (F.col(group) == F.col("_group")) & (F.col("a") == F.col("_a"))).select(group, "_of", "_of_part", "a", "b", "xy")
    kind = members.schema[group].dataType.simpleString()

    def spectra(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=[group, "weight", "_square", "lam", "at", "taken"])
        own = own.sort_values(variant, kind="stable").reset_index(drop=True)
        places = pd.Index(own[variant])
        i, j = places.get_indexer(cells.a), places.get_indexer(cells.b)
        known = (i >= 0) & (j >= 0)
        i, j, xy = i[known], j[known], cells.xy.to_numpy()[known]
        s = own._s.to_numpy()
        whole = len(own) == own.n_variants.iloc[0]
        out = []
        for name in weights:
            w = own[name].to_numpy()
            x = xy * w[i] * w[j]
            square = float(x.sum() + x[i != j].sum())
            lam, at, taken = _block_spectrum(i, j, variance * x, w * s * math.sqrt(variance / n), whole)
            some = at > 1e-12 * lam.max(initial=0)
            out.append((own[group].iloc[0], name, square, lam[lam > 1e-12 * lam.max(initial=0)], at[some], taken[some]))
        return pd.DataFrame(out, columns=[group, "weight", "_square", "lam", "at", "taken"])

    def tails(pdf: pd.DataFrame) -> pd.DataFrame:
        lam, at, taken = (np.concatenate(pdf[c].to_list()) for c in ("lam", "at", "taken"))
        least = 1e-12 * lam.max(initial=0)
        p = mixture_tail(float(pdf.q.iloc[0]), lam[lam > least], tail, taken[at > least], at[at > least])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "weight": [pdf.weight.iloc[0]], "p_kernel": [p]})

    blocks = own.groupBy(group, "_block", "_part").cogroup(cells.groupBy(group, "_of", "_of_part")).applyInPandas(spectra, f"`{group}` {kind}, weight string, _square double, lam array<double>, at array<double>, taken array<double>")
    blocks = settle(blocks)
    u = F.col("_u") - F.col("_s") * F.lit(total / n if n else 0.0)
    of_weight = lambda w: F.struct(F.lit(w).alias("weight"), *[F.sum(x).alias(c) for c, x in (("_wu", F.col(w) * u), ("q", F.pow(F.col(w) * u, F.lit(2))), ("_g", F.pow(w, F.lit(2)) * F.col("_g")), ("_ws", F.col(w) * F.col("_s")))])
    per = stats.groupBy(group).agg(F.count("*").alias("n_variants"), F.array(*[of_weight(w) for w in weights]).alias("_e"))
    per = per.select(group, "n_variants", F.explode("_e").alias("_e")).select(group, "n_variants", "_e.*").join(blocks.groupBy(group, "weight").agg(F.sum("_square").alias("_square")), [group, "weight"])
    wsw = variance * (F.col("_square") - F.col("_ws") * F.col("_ws") / n)
    chi2 = F.when(wsw > 1e-12 * variance * F.col("_g"), F.col("_wu") * F.col("_wu") / wsw)
    out = settle(per.select(group, "n_variants", "weight", chi2.alias("chi2"), erfc_exact(F.sqrt(chi2 / 2)).alias("p_burden"), "q"))
    asked = out.where(F.col("chi2").isNotNull()).select(group, "weight", "q")
    kernel = blocks.join(F.broadcast(asked), [group, "weight"]).groupBy(group, "weight").applyInPandas(tails, f"`{group}` {kind}, weight string, p_kernel double")
    return out.join(kernel, [group, "weight"], "left").select(group, "n_variants", "weight", "chi2", "p_burden", "q", "p_kernel")


def set_omnibus(tests: DataFrame, group: str) -> DataFrame:
    """Cauchy combination of both tests under all weightings of each group (:func:`set_tests`)."""
    long = tests.select(group, F.explode(F.array("p_burden", "p_kernel")).alias("p")).where(F.col("p").isNotNull())
    return omnibus(long, [group], "p")


def lambda_gc(df: DataFrame, p: str, mode: str = "chi2_1df") -> DataFrame:
    """Genomic inflation: median statistic over its expectation.

    ``chi2_1df`` inverts the tail at the median p (bisection on the monotone tail),
    ``log_2df`` is the median of 2 |ln p| over ln 4.
    """
    if mode == "log_2df":
        logs = df.select((2.0 * F.abs(F.log(p))).alias("_l"))
        return linear_quantiles(logs, "_l", [0.5]).select((F.col("q")[0] / 1.3863).alias("lambda_gc"))
    median = linear_quantiles(df.select(p), p, [0.5]).select(F.col("q")[0].alias("m"))

    @F.pandas_udf("double")
    def inverse(s: pd.Series) -> pd.Series:
        def one(m: float) -> float:
            if not 0 < m <= 1:
                return float("nan")
            lo, hi = 0.0, 2000.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2)) > m else (lo, mid)
            return lo

        return s.map(one, na_action="ignore")

    return median.select((inverse("m") / CHI2_MEDIAN_1DF).alias("lambda_gc"))


def sidak(p: Column, m: Column) -> Column:
    """1 - (1 - p)^m without cancellation."""
    return -F.expm1(m * F.log1p(-p))


def threshold_comparison(a: Column, b: Column, alpha: float) -> Column:
    """gain, loss, tie (both pass), or unmeasurable (neither passes or is known)."""
    sa, sb = F.coalesce(a <= alpha, F.lit(False)), F.coalesce(b <= alpha, F.lit(False))
    return F.when(sa & sb, "tie").when(sb, "gain").when(sa, "loss").otherwise("unmeasurable")


def spearman(df: DataFrame, x: str, y: str, group: list[str], least: int = 3) -> DataFrame:
    """Spearman correlation of each group over complete pairs; NULL for few rows or a constant.

    Ranks come from counted values and rows from counted pairs of values, so neither a group
    nor a frequent value meets in one task.
    """
    each = settle(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y))
    rows = each.groupBy(*group, x, y).agg(F.count("*").alias("_w"))
    for c, name in ((x, "_rx"), (y, "_ry")):
        ranks = value_ranks(each, c, group).select(*group, c, (F.col("n_below") + (F.col("n_at") + 1) / 2.0).alias(name))
        rows = rows.join(ranks, [*group, c])
    n = rows.groupBy(*group).agg(F.sum("_w").alias("n"))
    middle = (F.col("n") + 1) / 2.0
    rows = rows.join(n, group).select(*group, "n", "_w", (F.col("_rx") - middle).alias("_a"), (F.col("_ry") - middle).alias("_b"))
    sums = rows.groupBy(*group).agg(F.max("n").alias("n"), *[F.sum(F.col("_w") * F.col(p) * F.col(q)).alias(p + q) for p, q in (("_a", "_a"), ("_a", "_b"), ("_b", "_b"))])
    sound = (F.col("n") >= least) & (F.col("_a_a") > 0) & (F.col("_b_b") > 0)
    return sums.select(*group, "n", F.when(sound, F.col("_a_b") / F.sqrt(F.col("_a_a") * F.col("_b_b"))).alias("rho"))


def kendall_tau_b(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """``group, tau``: Kendall's tau-b of groups of any size over complete pairs; NULL where x or y is constant.

    Discordant pairs are counted without making pairs, as merge sort counts inversions, with
    the merges laid side by side: values of y get codes that keep their order, and two codes
    differ first in one bit.  At each bit, rows with equal higher bits form a node; a row
    whose bit is 0 is discordant with the rows of its node that have bit 1 and a smaller x,
    which a running sum by x gives.  A row takes part once a bit; the sums go by buckets of
    x, so neither a group nor a node has to be one task's.
    """
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y)
    codes = settle(value_ranks(complete, y, group).select(*group, y, F.col("n_below").cast("long").alias("_code")))
    cells = complete.groupBy(*group, x, y).agg(F.count("*").alias("_n"))
    cells = settle(cells.join(codes, [*group, y]))
    bits = int(cells.agg(F.coalesce(F.max("_code"), F.lit(0))).first()[0]).bit_length()
    pair = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    tied_x = cells.groupBy(*group, x).agg(F.sum("_n").alias("_n")).groupBy(*group).agg(pair("_n").alias("_tx"), F.sum("_n").alias("_all"))
    tied_y = cells.groupBy(*group, y).agg(F.sum("_n").alias("_n")).groupBy(*group).agg(pair("_n").alias("_ty"))
    tied = cells.groupBy(*group).agg(pair("_n").alias("_txy"))
    level = cells.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(max(0, bits - 1)))))
    one = F.expr("shiftright(_code, _level) % 2")
    nodes = level.select(*group, "_level", F.expr("shiftright(_code, _level + 1)").alias("_node"), F.col(x), one.alias("_bit"), "_n")
    before = running(nodes, [*group, "_level", "_node"], [x], quantile_bucket(cells, x), {"_above": ("sum", F.col("_n") * F.col("_bit"))}, exclusive=True)
    discordant = before.where("_bit = 0").groupBy(*group).agg(F.sum(F.col("_n").cast("double") * F.col("_above")).alias("_d"))
    totals = tied_x.join(tied_y, group).join(tied, group).join(discordant, group, "left")
    every = F.col("_all").cast("double") * (F.col("_all") - 1) / 2
    free_x, free_y = every - F.col("_tx"), every - F.col("_ty")
    score = every - F.col("_tx") - F.col("_ty") + F.col("_txy") - 2 * F.coalesce(F.col("_d"), F.lit(0.0))
    return totals.select(*group, F.when((free_x > 0) & (free_y > 0), score / F.sqrt(free_x * free_y)).alias("tau"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def sign_test(successes: Column, n: Column) -> Column:
    """Two-sided exact binomial test against one half, in Arrow batches (log space)."""

    @F.pandas_udf("double")
    def p(k: pd.Series, n: pd.Series) -> pd.Series:
        def one(k: int, n: int) -> float:
            low = min(k, n - k)
            tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(low + 1))
            return min(1.0, 2 * tail)

        return pd.Series([one(int(a), int(b)) for a, b in zip(k, n)])

    return p(successes, n)


def clopper_pearson(successes: Column, n: Column, alpha: float = 0.05) -> Column:
    """``struct(low, high)`` exact binomial interval by bisection of the binomial tail."""

    @F.pandas_udf("low double, high double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        def upper_tail(p: float, k: int, n: int) -> float:
            return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))

        def solve(k: int, n: int, want: float) -> float:
            lo, hi = 1e-15, 1 - 1e-15
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if upper_tail(mid, k, n) < want else (lo, mid)
            return lo

        rows = [(0.0 if a == 0 else solve(int(a), int(b), alpha / 2), 1.0 if a == b else solve(int(a) + 1, int(b), 1 - alpha / 2)) for a, b in zip(k, n)]
        return pd.DataFrame(rows, columns=["low", "high"])

    return interval(successes, n)


def ks_distance(df: DataFrame, value: str, sample: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance (``sample`` is 0 or 1)."""
    per = df.groupBy(value).agg(F.sum((F.col(sample) == 0).cast("long")).alias("a"), F.sum((F.col(sample) == 1).cast("long")).alias("b"))
    totals = per.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    run = running(per, [], [value], quantile_bucket(per, value), {"ca": ("sum", F.col("a")), "cb": ("sum", F.col("b"))})
    return run.crossJoin(F.broadcast(totals)).agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks"))


def soft_cross_entropy(p: Column, y: Column, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def average_precision(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under precision-recall by steps; equal scores are taken together."""
    per = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("long")).alias("t"))
    run = running(per, [], [score], quantile_bucket(per, score), {"cn": ("sum", F.col("n")), "ct": ("sum", F.col("t"))}, backward=True)
    total = per.agg(F.sum("t").alias("tt"))
    return run.crossJoin(F.broadcast(total)).agg(F.sum(F.col("t") * F.col("ct") / F.col("cn") / F.col("tt")).alias("average_precision"))


def r_squared(df: DataFrame, y: str, fitted: str) -> DataFrame:
    return df.agg((1.0 - F.sum(F.pow(F.col(y) - F.col(fitted), F.lit(2))) / (F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count(y))).alias("r2"))


def top_k_recall(scored: DataFrame, truth: DataFrame, key: str, score: str, ks: list[int]) -> DataFrame:
    """Share of the true keys among the k best scores, for each k (only the largest k rows are ranked)."""
    best = scored.orderBy(F.desc(score), key).limit(max(ks))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key))).join(truth.select(key).distinct().withColumn("_true", F.lit(1)), key, "left")
    total = truth.select(key).distinct().agg(F.count("*").alias("n_true"))
    hits = ranked.agg(*[F.count_if((F.col("rank") <= k) & F.col("_true").isNotNull()).alias(f"k{k}") for k in ks]).crossJoin(total)
    return hits.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits"), (F.col(f"k{k}") / F.col("n_true")).alias("recall")) for k in ks])).alias("r")).select("r.*")


def ld_pairs(dosage: DataFrame, variant: str, person: str, ds: str, n_people: int, place: str | None = None, reach: float | None = None, group: str | None = None) -> DataFrame:
    """r and r2 of variant pairs with a shared carrier over all persons (absent rows are zero), from sums over those carriers.

    ``group`` keeps to pairs within a group of variants and returns its column too.
    """
    keys = [group] if group else []
    per = dosage.groupBy(*keys, variant).agg(F.sum(ds).alias("s"), F.sum(F.col(ds) * F.col(ds)).alias("q"))
    cols = [*keys, person, variant, ds] + ([place] if place else [])
    left, right = dealt_sides(dosage.select(*cols), [*keys, person], variant)
    a = left.withColumnsRenamed({variant: "a", ds: "x"} | ({place: "pa"} if place else {}))
    b = right.withColumnsRenamed({variant: "b", ds: "y"} | ({place: "pb"} if place else {}))
    near = (F.col("a") < F.col("b")) & ((F.abs(F.col("pa") - F.col("pb")) <= reach) if place and reach is not None else F.lit(True))
    both = a.join(b, [*keys, person, "_deal"]).where(near).groupBy(*keys, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.count("*").alias("n_shared"))
    of_a = per.select(*keys, F.col(variant).alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa"))
    of_b = per.select(*keys, F.col(variant).alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb"))
    out = both.join(of_a, [*keys, "a"]).join(of_b, [*keys, "b"])
    n = float(n_people)
    va, vb = F.col("qa") / n - F.pow(F.col("sa") / n, F.lit(2)), F.col("qb") / n - F.pow(F.col("sb") / n, F.lit(2))
    r = F.when((va > 0) & (vb > 0), (F.col("xy") / n - F.col("sa") / n * F.col("sb") / n) / F.sqrt(va * vb))
    return out.select(*keys, "a", "b", "n_shared", r.alias("r"), (r * r).alias("r2"))


def effective_tests(pairs: DataFrame, m: int) -> DataFrame:
    """M_eff = M^2 / sum of squared correlations (the diagonal included), without eigenvalues."""
    return pairs.agg((F.lit(float(m) ** 2) / (m + 2 * F.sum("r2"))).alias("m_eff"))


def effective_rank(df: DataFrame, group: str, vector: str) -> DataFrame:
    """exp of the entropy of normalised singular values of each group's centred matrix; NULL for a constant or single row.

    Tasks sum products of coordinates; only these square matrices meet, whatever the rows.
    Rows without a vector or with a coordinate that is NULL or not finite are left out.
    """
    kind = df.schema[group].dataType.simpleString()

    def partial(frames):
        held: dict = {}
        for pdf in frames:
            for key, own in pdf.groupby(group, dropna=False, sort=False)[vector]:
                whole = [v for v in own if v is not None and np.isfinite(v).all()]
                held.setdefault(key, np.zeros(0))
                if whole:
                    x = np.column_stack([np.ones(len(whole)), np.array(whole, float)])
                    held[key] = x.T @ x + (held[key] if held[key].size else 0)
        if held:  # a partition without rows has no frame that Arrow could type
            yield pd.DataFrame({group: list(held), "_products": [m.ravel() for m in held.values()]})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [g for g in pdf._products if len(g)]
        if not parts:
            return pd.DataFrame({group: [pdf[group].iloc[0]], "effective_rank": [None]})
        g = np.sum(parts, axis=0)
        g = g.reshape(int(np.sqrt(len(g))), -1)
        cov = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0]
        lam = np.linalg.eigvalsh(cov)
        s = np.sqrt(lam[lam > 1e-12 * np.abs(g[1:, 1:]).max(initial=0)])
        p = s / s.sum() if len(s) else s
        return pd.DataFrame({group: [pdf[group].iloc[0]], "effective_rank": [float(np.exp(-(p * np.log(p)).sum())) if len(s) else None]})

    parts = df.select(group, F.col(vector).cast("array<double>").alias(vector)).mapInPandas(partial, f"{group} {kind}, _products array<double>")
    return parts.groupBy(group).applyInPandas(one, f"{group} {kind}, effective_rank double")


def co_carriers(dosage: DataFrame, variant: str, person: str, ds: str, threshold: float = 0.5, inside: list[str] | None = None) -> DataFrame:
    """Shared carriers of variant pairs (of one value of the columns ``inside``) and the Jaccard of their carrier sets."""
    inside = inside or []
    carried = settle(dosage.where(F.col(ds) >= threshold).select(*inside, variant, person).distinct())
    n = carried.groupBy(variant).agg(F.count_distinct(person).alias("n"))
    both = pairs_within(carried, [person], variant, inside)
    out = both.join(n.select(F.col(variant).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(variant).alias("b"), F.col("n").alias("nb")), "b")
    return out.select(*inside, "a", "b", "n_common", (F.col("n_common") / (F.col("na") + F.col("nb") - F.col("n_common"))).alias("jaccard"))


def pattern_recurrence(df: DataFrame, person: str, item: str) -> DataFrame:
    """How often each set of carried items occurs."""
    per = df.groupBy(person).agg(F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), ",").alias("pattern"))
    return per.groupBy("pattern").agg(F.count("*").alias("n"))


def coherence(df: DataFrame, group: list[str], z: str) -> DataFrame:
    """|sum z| / sqrt(n sum z^2)."""
    return df.groupBy(*group).agg(F.when(F.sum(F.col(z) * F.col(z)) > 0, F.abs(F.sum(z)) / F.sqrt(F.count(z) * F.sum(F.col(z) * F.col(z)))).alias("coherence"))


def cluster_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, normalised mutual information and pair Jaccard, from the contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pair = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("x")), cells.groupBy(b).agg(F.sum("n").alias("x"))
    both = cells.agg(pair("n").alias("s"), F.sum("n").alias("nt")).crossJoin(rows.agg(pair("x").alias("sa"))).crossJoin(cols.agg(pair("x").alias("sb")))
    nt = F.col("nt")
    expected = F.col("sa") * F.col("sb") / (nt * (nt - 1) / 2.0)
    ari = (F.col("s") - expected) / ((F.col("sa") + F.col("sb")) / 2.0 - expected)
    mi = mutual_information(df, a, b).select("nmi")
    return both.select(ari.alias("ari"), (F.col("s") / (F.col("sa") + F.col("sb") - F.col("s"))).alias("pair_jaccard")).crossJoin(mi)


def mixture_em(df: DataFrame, t2: str, rounds: int = 50) -> tuple[float, float]:
    """Share and scale of the inflated part of squared scores: chi-square plus scaled chi-square.

    Squared scores are counted in fine bins first, so a round needs only the bounded table.
    """
    binned = df.where(F.col(t2).isNotNull()).groupBy(F.floor(F.least(F.col(t2), F.lit(200.0)) * 100).alias("b")).agg(F.count("*").alias("n"), F.avg(t2).alias("x")).toPandas()
    x, n = np.maximum(binned.x.to_numpy(float), 1e-9), binned.n.to_numpy(float)
    share, scale = 0.1, max(2.0, float((x * n).sum() / n.sum()) * 2)
    for _ in range(rounds):
        null = np.exp(-x / 2) / np.sqrt(x)
        alt = np.exp(-x / 2 / scale) / np.sqrt(x * scale)
        r = share * alt / (share * alt + (1 - share) * null)
        share = float((r * n).sum() / n.sum())
        scale = max(1.0, float((r * n * x).sum() / max((r * n).sum(), 1e-12)))
    return share, scale


def exact_two_sided(z: Column) -> Column:
    return erfc_exact(F.abs(z) / math.sqrt(2.0))


def two_sided(z: Column) -> Column:
    return 2.0 * normal_sf(F.abs(z))


def power_grid(effects: list[float], sizes: list[int], reps: int, seed: int, spark, alpha: float = 0.05) -> DataFrame:
    """Rejection share of a z test by simulation, one (effect, size) cell a task."""
    cells = spark.createDataFrame([(float(e), int(n)) for e in effects for n in sizes], "effect double, n int")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        effect, n = float(pdf.effect.iloc[0]), int(pdf.n.iloc[0])
        rng = np.random.default_rng([seed, n, int(round(effect * 1e6))])
        z = rng.standard_normal(reps) + effect * math.sqrt(n)
        p = np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z])
        return pd.DataFrame({"effect": [effect], "n": [n], "power": [float((p <= alpha).mean())]})

    return cells.groupBy("effect", "n").applyInPandas(one, "effect double, n int, power double")

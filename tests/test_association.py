"""Variance-component tests over sparse dosages against the dense matrices."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from strandset.operators import association as st


def test_sparse_covariance_is_the_dense_one(spark):
    rng = np.random.default_rng(3)
    n, m = 40, 6
    x = np.where(rng.random((n, m)) < 0.2, rng.random((n, m)) * 2, 0.0)
    x[:, 4] = 0
    x[:2, 4] = 1.0
    x[:, 5] = 0
    x[38:, 5] = 1.5  # shares no carrier with variant 4
    rows = [(p, v, "g" if v != 3 else "h", float(x[p, v])) for p in range(n) for v in range(m) if x[p, v]]
    dose = spark.createDataFrame(rows, "person long, variant long, gene string, ds double")
    z = (x - x.mean(0)) / x.std(0)
    u, w = rng.normal(size=m), rng.random(m) + 0.5
    mean = x.mean(0) / x.std(0)
    stats = spark.createDataFrame([(v, "g" if v != 3 else "h", float(u[v]), float(w[v]), float(mean[v])) for v in range(m)], "id long, gene string, u double, w double, mean double")
    ld = st.ld_pairs(dose, "variant", "person", "ds", n, group="gene").select("gene", "a", "b", F.col("r").alias("s"))
    assert not ld.where("a = 4 and b = 5").count()
    own = stats.select("gene", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("s"))
    cov = ld.unionByName(ld.select("gene", F.col("b").alias("a"), F.col("a").alias("b"), "s")).unionByName(own)
    burden = {r.gene: r.chi2 for r in st.burden_test(stats, cov, "gene", "id", mean="mean").collect()}
    kernel = {r.gene: r for r in st.skat(stats, cov, "gene", "id", mean="mean", tail="liu").collect()}
    for gene, of in {"g": [0, 1, 2, 4, 5], "h": [3]}.items():
        full = np.diag(w[of]) @ (z[:, of].T @ z[:, of] / n) @ np.diag(w[of])
        assert math.isclose(burden[gene], (w[of] @ u[of]) ** 2 / full.sum(), rel_tol=1e-9)
        lam = np.linalg.eigvalsh(full)
        q = ((w[of] * u[of]) ** 2).sum()
        assert math.isclose(kernel[gene].q, q, rel_tol=1e-12)
        assert math.isclose(kernel[gene].p, st._liu_tail(q, lam[lam > 1e-12]), rel_tol=1e-7, abs_tol=1e-12)


def test_small_tails_have_small_relative_errors():
    # equal weights: a scaled chi-square; two pairs of weights: a mixture of two exponentials
    for k in (1, 2, 5, 30, 400):
        for q in (0.3 * k, k, 1.2 * k, k + 30, k + 90, 3 * k + 300):
            p, error = st._inverted_tail(q, np.ones(k))
            assert math.isclose(p, st._gammaq(k / 2, q / 2), rel_tol=1e-7) and error < 1e-6
    a, b = 1.0, 0.3
    for q in (0.1, 5.0, 30.0, 80.0, 200.0):
        want = (a * math.exp(-q / 2 / a) - b * math.exp(-q / 2 / b)) / (a - b)
        assert math.isclose(st.mixture_tail(q, np.array([a, a, b, b])), want, rel_tol=1e-8)
    started = time.perf_counter()
    for _ in range(50):
        st.mixture_tail(2000.0, np.concatenate([[50.0], np.linspace(0.1, 1, 30)]))
    assert (time.perf_counter() - started) / 50 < 0.05
    assert st.mixture_tail(0.0, np.array([1.0])) == st.mixture_tail(3.0, np.zeros(2)) == 1.0


def test_set_tests_are_the_dense_ones(spark, monkeypatch):
    monkeypatch.setattr(st, "EXPANDED_PAIRS", 7)
    rng = np.random.default_rng(11)
    n, m = 60, 9
    x = np.where(rng.random((n, m)) < 0.3, rng.integers(1, 3, (n, m)), 0).astype(float)
    x[:, 8] = 0
    gene = ["g"] * 6 + ["h"] * 3
    r = rng.normal(size=n) + 0.3
    w = {"one": np.ones(m), "wide": rng.random(m) + 0.1, "none": np.zeros(m)}
    dose = spark.createDataFrame([(p, v, float(x[p, v])) for p in range(n) for v in range(m) if x[p, v]], "person long, variant long, ds double").repartition(3)
    members = spark.createDataFrame([(v, gene[v], *(float(c[v]) for c in w.values())) for v in range(m)], "variant long, gene string, one double, wide double, none double")
    resid = spark.createDataFrame([(p, float(r[p])) for p in range(n)], "person long, resid double")
    got = {(t.gene, t.weight): t for t in st.set_tests(dose, members, resid, "gene", "variant", "person", "ds", list(w)).collect()}
    assert len(got) == 6
    for g in "gh":
        of = [v for v in range(8) if gene[v] == g]
        centred = x[:, of] - x[:, of].mean(0)
        cov, u = r.var() * centred.T @ centred, centred.T @ r
        for name in ("one", "wide"):
            c = w[name][of]
            t = got[g, name]
            assert t.n_variants == len(of)
            assert math.isclose(t.chi2, (c @ u) ** 2 / (c @ cov @ c), rel_tol=1e-9)
            assert math.isclose(t.q, ((c * u) ** 2).sum(), rel_tol=1e-9)
            draws = (np.random.default_rng(2).chisquare(1, (200_000, len(of))) * np.linalg.eigvalsh(cov * np.outer(c, c))).sum(1)
            assert abs(t.p_kernel - (draws > t.q).mean()) < 5e-3
        assert got[g, "none"].chi2 is None and got[g, "none"].p_kernel is None
    assert {t.gene: t.n_tests for t in st.set_omnibus(st.set_tests(dose, members, resid, "gene", "variant", "person", "ds", list(w)), "gene").collect()} == {"g": 4, "h": 4}
    # the pair form gives the same kernel test
    one = st.set_products(dose.join(members.select("variant", "gene"), "variant"), "gene", "variant", "person", "ds")
    full = {(c.gene, c.a, c.b): c.xy for c in one.collect()}
    want = {(gene[a], a, b): float(x[:, a] @ x[:, b]) for a in range(m) for b in range(a, m) if gene[a] == gene[b] and x[:, a] @ x[:, b]}
    assert full == want


def test_effective_rank_of_empty_partitions_and_broken_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 3))
    rows = [(i % 2, v.tolist()) for i, v in enumerate(x)]
    odd = [(0, None), (1, [1.0, None, 2.0]), (1, [float("nan"), 0.0, 1.0]), (2, None)]
    df = spark.createDataFrame(rows + odd, "label int, e array<double>").repartition(40)
    got = {r.label: r.effective_rank for r in st.effective_rank(df, "label", "e").collect()}
    for k in (0, 1):
        s = np.linalg.svd(x[k::2] - x[k::2].mean(0), compute_uv=False)
        p = s / s.sum()
        assert math.isclose(got[k], np.exp(-(p * np.log(p)).sum()), rel_tol=1e-9)
    assert got[2] is None and len(got) == 3
    assert not st.effective_rank(df.where("label = 9"), "label", "e").collect()


def test_large_groups_fall_apart_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    n, m = 120, 30
    x = np.zeros((n, m))
    for k in range(3):  # three blocks of variants without a shared carrier; variant 29 is alone
        x[k * 35 : (k + 1) * 35, k * 9 : (k + 1) * 9] = np.where(rng.random((35, 9)) < 0.4, rng.random((35, 9)) * 2, 0.0)
    x[110, 29] = 1.5
    dose = spark.createDataFrame([(p, v, float(x[p, v])) for p in range(n) for v in range(m) if x[p, v]], "person long, variant long, ds double")
    resid = spark.createDataFrame([(p, float(r)) for p, r in enumerate(rng.normal(size=n))], "person long, resid double")
    members = spark.createDataFrame([(v, "g", float(rng.random() + 0.1), 1.0) for v in range(m)], "variant long, gene string, w1 double, w2 double")
    args = (dose, members, resid, "gene", "variant", "person", "ds", ["w1", "w2"])
    whole = {r.weight: r for r in st.set_tests(*args).collect()}
    plain = {r.weight: r for r in st.set_statistics(*args).collect()}
    monkeypatch.setattr(st, "WHOLE_VARIANTS", 5)
    monkeypatch.setattr(st, "TAIL_CELLS", 50)
    monkeypatch.setattr(np.linalg, "eigvalsh", lambda a: (_ for _ in ()).throw(AssertionError("a whole matrix")))
    parts = {r.weight: r for r in st.set_tests(*args).collect()}
    liu = {r.weight: r.p_kernel for r in st.set_tests(*args, tail="liu").collect()}
    monkeypatch.undo()
    liu_whole = {r.weight: r.p_kernel for r in st.set_tests(*args, tail="liu").collect()}
    for w, r in whole.items():
        assert parts[w].n_variants == r.n_variants == plain[w].n_variants == 28
        for c in ("chi2", "p_burden", "q", "p_kernel"):
            assert math.isclose(parts[w][c], r[c], rel_tol=1e-8)
        assert math.isclose(plain[w].chi2, r.chi2, rel_tol=1e-9) and math.isclose(plain[w].q, r.q, rel_tol=1e-9) and math.isclose(liu[w], liu_whole[w], rel_tol=1e-8)


def test_tails_of_a_matrix_less_one_rank():
    rng = np.random.default_rng(6)
    for m in (1, 2, 5, 60):
        for share in (0.1, 0.9, 0.999):
            lam = np.sort(rng.random(m) * 3 + 0.1)
            z = rng.normal(size=m)
            z *= math.sqrt(share / (z * z / lam).sum())  # the difference has no negative eigenvalue
            direct = np.linalg.eigvalsh(np.diag(lam) - np.outer(z, z))
            direct = direct[direct > 1e-12]
            assert math.isclose(st._largest(lam, z * z), direct.max(), rel_tol=1e-9)
            for q in (0.2, 1.0, 3.0, 10.0):
                q *= direct.sum()
                assert math.isclose(st.mixture_tail(q, lam, taken=z * z), st.mixture_tail(q, direct), rel_tol=1e-6)

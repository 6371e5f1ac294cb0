"""Set tests of large groups: blocks, standardised weights, means by Lanczos' steps."""

import math
import tracemalloc

import numpy as np
import pandas as pd

from strandset.operators import association as st


def tables(spark, x, genes, seed=3):
    n, m = x.shape
    p, v = np.nonzero(x)
    dose = spark.createDataFrame(pd.DataFrame({"person": p, "variant": v, "ds": x[p, v]}))
    resid = spark.createDataFrame(pd.DataFrame({"person": np.arange(n), "resid": np.random.default_rng(seed).normal(size=n)}))
    return dose, spark.createDataFrame(pd.DataFrame({"variant": np.arange(m), "gene": genes})), resid


def test_a_long_chain_of_links_takes_one_round(spark, monkeypatch):
    monkeypatch.setattr(st, "FOREST_LINKS", 50)
    n = 400
    order = np.random.default_rng(1).permutation(n)
    links = [("g", int(min(a, b)), int(max(a, b)), 1.0) for a, b in zip(order[:299], order[1:300])] + [("g", int(a), int(a), 1.0) for a in order]
    links += [("h", 5, 7, 1.0), ("h", 7, 9, 0.0)]
    products = spark.createDataFrame(links, "gene string, a long, b long, xy double").repartition(7)
    sizes = spark.createDataFrame([("g", 699), ("h", 2)], "gene string, n_links long")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {(r.gene, r.variant): r._block for r in st.shared_blocks(products, sizes, "gene").collect()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 12  # rounds of stars took more than ten a round
    assert got == {("g", int(v)): int(order[:300].min()) for v in order[:300]} | {("h", 5): 5, ("h", 7): 5}


def test_standardised_weights_and_blocks_are_the_dense_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.zeros((900, 460))
    x[:800, :400] = np.where(rng.random((800, 400)) < 0.02, rng.random((800, 400)), 0)
    x[800:840, 400:410] = np.where(rng.random((40, 10)) < 0.5, rng.random((40, 10)), 0)
    x[range(840, 890), range(410, 460)] = 1.0
    args = *tables(spark, x, "g"), "gene", "variant", "person", "ds", []
    whole = st.set_tests(*args, standard="w").first()
    monkeypatch.setattr(st, "WHOLE_VARIANTS", 50)
    parts = st.set_tests(*args, standard="w").first()
    r = args[2].toPandas().sort_values("person").resid.to_numpy()
    centred = x - x.mean(0)
    w = 1 / np.sqrt(r.var() * (centred**2).sum(0))
    scaled = centred * w
    lam = np.linalg.eigvalsh(r.var() * scaled.T @ scaled)
    q = ((scaled.T @ r) ** 2).sum()
    want = {"chi2": (scaled.sum(1) @ r) ** 2 / (r.var() * (scaled.sum(1) ** 2).sum()), "q": q, "p_kernel": st.mixture_tail(q, lam[lam > 1e-10])}
    for row in (whole, parts):
        assert row.n_variants == 460 and row.weight == "w"
        assert all(math.isclose(row[c], v, rel_tol=1e-7) for c, v in want.items())


def test_a_large_block_holds_one_matrix():
    rng = np.random.default_rng(8)
    m = 900
    i, j = (np.append(c, np.arange(m)) for c in np.sort(rng.integers(0, m, (2, 9000)), axis=0))
    x, z = np.append(rng.random(9000) * 0.1, np.full(m, 5.0)), rng.random(m) * 0.05
    tracemalloc.start()
    lam, at, taken = st._block_spectrum(i, j, x, z, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 8 * m * m  # the products, their scaled copy and the eigenvectors made it more than four
    full = np.zeros((m, m))
    full[i, j] = full[j, i] = x
    own, vectors = np.linalg.eigh(full)
    assert np.allclose(lam, own, rtol=1e-9)
    assert np.isclose((taken / (7 + at)).sum(), ((vectors.T @ z) ** 2 / (7 + own)).sum(), rtol=1e-12)
    assert np.allclose(st._block_spectrum(i, j, x, z, True)[0], np.linalg.eigvalsh(full - np.outer(z, z)), rtol=1e-9)

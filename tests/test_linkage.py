"""Blocked and streamed linkage, chains, spectra, consensus, parallel clumps and counted inversions against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandset.operators import association as st
from strandset.operators import clustering as cl
from strandset.operators import linkage as lk


def correlated(n, dims=40, seed=1):
    """Rows in runs of near copies, some of which cross any border."""
    rng = np.random.default_rng(seed)
    out, base = [], None
    for k in range(n):
        if base is None or rng.random() < 0.3:
            base = rng.normal(size=dims)
        out.append(base + rng.normal(size=dims) * rng.choice([0.05, 0.3, 0.6]))
    return np.array(out)


def plain_teams(x, threshold):
    """Merge the two teams with the highest least r2 until none is above the threshold."""
    r2 = np.corrcoef(x) ** 2
    teams = [[k] for k in range(len(x))]
    while True:
        best = None
        for i in range(len(teams)):
            for j in range(i):
                s = min(r2[a, b] for a in teams[i] for b in teams[j])
                if s > threshold and (best is None or s > best[0]):
                    best = (s, j, i)
        if best is None:
            return {k: min(t) for t in teams for k in t}
        teams[best[1]] += teams.pop(best[2])


def table(spark, groups):
    rows = [(g, f"k{i:04d}", 1000 + 7 * (i // 2), [float(v) for v in x[i]]) for g, x in groups.items() for i in range(len(x))]
    return spark.createDataFrame(rows, "chrom string, key string, pos long, v array<double>").repartition(5)


def test_blocked_linkage(spark):
    groups = {"1": correlated(70), "2": correlated(23, seed=2)}
    groups["2"][5] = 3.0  # constant
    df = table(spark, groups)
    whole, none = lk.blocked_linkage(df, ["chrom"], "key", "pos", "v", block=500)
    got = {(r.chrom, r.idx): r.team for r in whole.collect()}
    with np.errstate(invalid="ignore"):
        want = {(g, k): t for g, x in groups.items() for k, t in plain_teams(np.nan_to_num(x), 0.8).items()}
    assert {k: v for k, v in got.items() if k != ("2", 5)} == {k: v for k, v in want.items() if k != ("2", 5)} and got["2", 5] == 5
    assert none.count() == 0
    teams, borders = lk.blocked_linkage(df, ["chrom"], "key", "pos", "v", block=16, border=5)
    for r in teams.collect():
        lo = r.idx // 16 * 16
        if (r.chrom, r.idx) != ("2", 5):
            assert r.block == r.idx // 16 and r.team - lo == plain_teams(np.nan_to_num(groups[r.chrom][lo : lo + 16]), 0.8)[r.idx - lo]
    for r in borders.collect():
        x, at = groups[r.chrom], (r.border + 1) * 16
        hits = np.nan_to_num(np.corrcoef(x[at - 5 : at], x[at : at + 5])[:5, 5:]) ** 2 > 0.8
        assert (r.tested_pairs, r.high_pairs, r.left_involved, r.right_involved) == (hits.size, hits.sum(), hits.any(1).sum(), hits.any(0).sum())
    assert borders.count() == 4 + 1 and borders.agg(F.sum("high_pairs")).first()[0] > 0


def streamed(spark, tmp_path, order, groups, block=16, border=5):
    """Writes the rows in parts in the given order and runs the stream over one part a trigger."""
    schema = "chrom string, key string, idx long, n long, v array<double>"
    for part, rows in enumerate(order):
        data = [(g, f"k{i:04d}", i, len(groups[g]), [float(v) for v in groups[g][i]]) for g, i in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p={part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("basePath", f"{tmp_path}/in").parquet(f"{tmp_path}/in/*")
    out = lk.stream_linkage(stream, "chrom", "key", "idx", "n", "v", block=block, border=border)
    name = f"s{abs(hash(str(tmp_path)))}"
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()
    return spark.table(name).collect()


def test_stream_equals_the_batch(spark, tmp_path):
    groups = {"1": correlated(70), "2": correlated(23, seed=2)}
    rows = [("1", i) for i in [*range(0, 20), 25, 23, 30, 31]] + [("2", i) for i in range(9)]
    parts = [rows, [("1", i) for i in (20, 21, 22, 24, *range(26, 30), *range(32, 45))], [("2", i) for i in range(9, 23)] + [("1", i) for i in range(45, 70)]]
    got = streamed(spark, tmp_path, parts, groups)
    teams, borders = lk.blocked_linkage(table(spark, groups), ["chrom"], "key", "pos", "v", block=16, border=5)
    assert {(r.chrom, r.key, r.idx, r.block, r.team) for r in got if r.kind == "team"} == {tuple(r) for r in teams.select("chrom", "key", "idx", "block", "team").collect()}
    assert sorted((r.chrom, r.block, r.tested_pairs, r.high_pairs, r.left_involved, r.right_involved) for r in got if r.kind == "border") == sorted(map(tuple, borders.collect()))


@pytest.mark.parametrize("rows", [[*range(0, 10), 40], [*range(0, 20), 3], [0, 1, 1]])
def test_out_of_order_rows_are_refused(rows):
    x, held = correlated(70), lk._Blocks(70, 16, 5, 0.8)
    with pytest.raises(lk.OrderError):
        for i in rows:
            list(held.push(i, i, x[i]))


def test_ward_is_the_greedy_merge(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.4, (9, 3)) for c in (0, 2, 5)])
    weight = rng.integers(1, 4, len(x)).astype(float)
    for mass in (np.ones(len(x)), weight):
        teams = [([k], x[k], mass[k]) for k in range(len(x))]
        for k in range(len(x) - 1, 0, -1):
            pairs = [(((a[1] - b[1]) ** 2).sum() * a[2] * b[2] / (a[2] + b[2]), i, j) for i, a in enumerate(teams) for j, b in enumerate(teams) if i < j]
            _, i, j = min(pairs)
            a, b = teams[i], teams.pop(j)
            teams[i] = (a[0] + b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2])
            got = lk.cut_merges(len(x), lk.ward_merges(x, mass), k)
            assert {frozenset(t[0]) for t in teams} == {frozenset(np.flatnonzero(np.array(got) == c).tolist()) for c in set(got)}
    df = spark.createDataFrame([("g", i, [float(v) for v in x[i]], float(weight[i])) for i in range(len(x))] + [("h", 1, [0.0, 0.0, 0.0], 1.0)], "g string, key long, v array<double>, w double")
    out = {(r.g, r.key): r.cluster for r in lk.ward(df, ["g"], "key", "v", 3, "w").collect()}
    assert [out["g", i] for i in range(len(x))] == lk.cut_merges(len(x), lk.ward_merges(x, weight), 3) and out["h", 1] == 0


def ring_graph(sizes, seed=3):
    """Dense parts joined by one weak edge each."""
    rng, edges, start = np.random.default_rng(seed), [], 0
    for n in sizes:
        edges += [(start + i, start + j, 1.0) for i in range(n) for j in range(i) if rng.random() < 0.6 or j == i - 1]
        if start:
            edges.append((start - 1, start, 0.2))
        start += n
    return edges


def test_spectral_embedding_and_clusters(spark):
    edges = ring_graph([14, 11, 9])
    df = spark.createDataFrame(edges, "a long, b long, w double").repartition(3)
    x = {r.node: [r.e0, r.e1, r.e2] for r in lk.spectral_embedding(df, 3, rounds=25).collect()}
    n = len(x)
    w = np.zeros((n, n))
    for a, b, v in edges:
        w[a, b] = w[b, a] = v
    d = w.sum(1)
    lam, vec = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    top = vec[:, np.argsort(-lam)[:3]]
    got = np.array([x[k] for k in range(n)])
    assert np.allclose(got.T @ got, np.eye(3), atol=1e-6)
    assert np.linalg.norm(top - got @ (got.T @ top)) < 0.02  # the same space
    labels = {r.node: r.cluster for r in lk.spectral(df, 3, rounds=12).collect()}
    parts = [range(0, 14), range(14, 25), range(25, 34)]
    assert all(len({labels[k] for k in p}) == 1 for p in parts) and len({labels[p[0]] for p in parts}) == 3


def test_consensus_of_runs(spark):
    rng = np.random.default_rng(9)
    truth = [k // 8 for k in range(24)]
    runs = [(r, i, int(truth[i] if rng.random() < 0.85 else rng.integers(-1, 3))) for r in range(20) for i in range(24) if rng.random() < 0.8]
    pairs = [(i, j) for i in range(24) for j in range(i + 1, 24)]
    shares = lk.co_association(spark.createDataFrame(runs, "run long, id long, cluster long"), spark.createDataFrame(pairs, "a long, b long")).cache()
    of = {}
    for r, i, c in runs:
        of.setdefault(r, {})[i] = c
    share = np.zeros((24, 24))
    for row in shares.collect():
        both = [(m[row.a], m[row.b]) for m in of.values() if row.a in m and row.b in m]
        assert (row.n_both, row.n_same) == (len(both), sum(a == b >= 0 for a, b in both))
        share[row.a, row.b] = share[row.b, row.a] = row.share
    teams = [[k] for k in range(24)]
    while len(teams) > 1:
        s, i, j = max((np.mean([share[a, b] for a in teams[i] for b in teams[j]]), i, j) for i in range(len(teams)) for j in range(i))
        if s < 0.5 - 1e-9:
            break
        teams[j] += teams.pop(i)
    got = {r.node: r.cluster for r in lk.consensus(shares).collect()}
    assert got == {k: min(t) for t in teams for k in t} and len(teams) == 3


def plain_clump(rows, near, lead_p, member_p):
    lead = {}
    for p, k in sorted((p, k) for k, p in rows if p <= member_p):
        if k not in lead and p <= lead_p:
            lead[k] = k
            for other in near.get(k, ()):
                if other in dict(rows) and dict(rows)[other] <= member_p:
                    lead.setdefault(other, k)
    return lead


@pytest.mark.parametrize("lead_p, member_p", [(None, None), (0.3, 0.8)])
def test_parallel_clumps_equal_the_loop(spark, lead_p, member_p):
    rng = np.random.default_rng(12)
    rows = [(k, float(rng.choice([rng.random(), 0.25]))) for k in range(160)]
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 160, (260, 2)) if a != b] + [(k, k + 1) for k in range(100, 140)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    df = spark.createDataFrame([("1", *r) for r in rows] + [("2", 5, 0.1)], "chrom string, key long, p double")
    links = spark.createDataFrame([("1", a, b) for a, b in edges], "chrom string, a long, b long")
    got = cl.greedy_ld_clump(df, links, ["chrom"], "key", "p", lead_p, member_p).collect()
    assert {r.key: r.lead for r in got if r.chrom == "1"} == plain_clump(rows, near, lead_p or 9, member_p or 9)
    assert all(r.is_lead == (r.key == r.lead) for r in got) and [(r.key, r.lead) for r in got if r.chrom == "2"] == [(5, 5)]
    assert len(got) == len({(r.chrom, r.key) for r in got})


def test_windowed_ld_clump_and_proxies(spark):
    rng = np.random.default_rng(2)
    n, m = 50, 12
    x = np.where(rng.random((n, m)) < 0.4, rng.integers(1, 3, (n, m)), 0).astype(float)
    x[:, 3], x[:, 7] = x[:, 2], x[:, 2]
    pos = [100 * k for k in range(m)]
    dose = spark.createDataFrame([(i, v, pos[v], float(x[i, v])) for i in range(n) for v in range(m) if x[i, v]], "person long, variant long, pos long, ds double")
    ld = st.ld_pairs(dose, "variant", "person", "ds", n, "pos", 300.0).where("r2 >= 0.5").withColumn("chrom", F.lit("1"))
    stats = spark.createDataFrame([("1", v, 0.01 * (v + 1) if v != 2 else 0.5) for v in range(m)], "chrom string, variant long, p double")
    got = {r.variant: r.lead for r in cl.greedy_ld_clump(stats, ld, ["chrom"], "variant", "p").collect()}
    assert got[2] == got[3] == 3 and got[7] == 7  # 2 and 7 are equal columns but 500 apart
    leads = stats.where("variant = 3")
    assert {(r.lead, r.proxy) for r in cl.ld_proxies(ld, leads, ["chrom"], "variant").collect()} == {(3, 3), (3, 2)}


def test_clumped_loci(spark):
    rng = np.random.default_rng(5)
    rows = [(c, k, int(rng.integers(0, 20_000)), float(rng.random())) for c in "12" for k in range(60)]
    df = spark.createDataFrame(rows, "chrom string, key long, pos long, p double")
    want = []
    for c in "12":
        leads = []
        for p, pos, k in sorted((p, pos, k) for g, k, pos, p in rows if g == c):
            if all(abs(pos - q) > 500 for q in leads):
                leads.append(pos)
        merged = []
        for q in sorted(leads):
            if merged and max(0, q - 400) <= merged[-1][1]:
                merged[-1][1:] = [q + 400, merged[-1][2] + 1]
            else:
                merged.append([max(0, q - 400), q + 400, 1])
        want += [(c, *m) for m in merged]
    assert sorted((r.chrom, r.start, r.end, r.n_leads) for r in cl.clumped_loci(df, ["chrom"], "key", "pos", "p", 500, 400).collect()) == sorted(want)


def test_kendall_without_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g, n, values in (("a", 90, 12), ("b", 60, 1000), ("c", 5, 2), ("d", 1, 3), ("e", 7, 1)):
        x = rng.integers(0, values, n)
        rows += [(g, float(a), float(b)) for a, b in zip(x, x // 2 + rng.integers(0, values, n) * (g != "e"))]
    rows += [("a", None, 1.0), ("a", 2.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(4)
    got = {r.g: r.tau for r in st.kendall_tau_b(df, "x", "y", ["g"]).collect()}
    for g in "abcde":
        own = pd.DataFrame([r[1:] for r in rows if r[0] == g and None not in r], columns=["x", "y"]).to_numpy()
        sx, sy = (np.sign(own[:, None, k] - own[None, :, k]) for k in (0, 1))
        free = (sx**2).sum() * (sy**2).sum()
        if free:
            assert math.isclose(got[g], (sx * sy).sum() / math.sqrt(free), rel_tol=1e-12)
        else:
            assert got[g] is None

"""Operators that no query can hold against SQL, each against results worked out by hand or a plain version."""

import io
import math
import tarfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandset.functions import columns as col
from strandset.operators import aggregates as ag
from strandset.operators import association as st
from strandset.operators import clustering as cl
from strandset.operators import haplotypes as hp
from strandset.operators import joins as jn
from strandset.operators import linear as ln
from strandset.operators import resampling as rs
from strandset.operators.sets import nearest_neighbours
from strandset.sources import readers as rd


def one(spark, *exprs):
    return spark.range(1).select(*exprs).first()


def test_columns(spark):
    up, down = one(spark, col.stronger(F.lit(0.2), F.lit(-0.7)), col.stronger(F.lit(-0.5), F.lit(0.5)))
    assert tuple(up) == (0.7, -1) and tuple(down) == (0.5, 1)
    assert tuple(one(spark, col.clip(F.lit(5.0), 0, 2), col.clip(F.lit(-5.0), 0, 2), col.neg_log10(F.lit(0.001)), col.neg_log10(F.lit(0.0)))) == (2, 0, pytest.approx(3), pytest.approx(300))
    df = spark.createDataFrame([(24,), (25,), (30,), (34,), (35,), (None,)], "p int")
    assert [r.p for r in df.where(col.outside(F.col("p"), 25, 34)).collect()] == [24, 35]
    assert one(spark, col.info_map(F.lit("AF=0.1;IMP;R2=.9")))[0] == {"AF": "0.1", "IMP": None, "R2": ".9"}
    assert tuple(one(spark, col.folded_count(F.lit(70), F.lit(50)), col.folded_count(F.lit(20), F.lit(50)), col.inverse_sd_weight(F.lit(0.5), 0.0))) == (30, 20, pytest.approx(2.0))
    assert one(spark, col.complement(F.lit("AacG")))[0] == "CGTT"
    assert [one(spark, col.phase_product(*map(F.lit, x)))[0] for x in ((1, 0, 1, 0), (1, 0, 0, 1), (1, 1, 0, 1))] == [1, -1, 0]


def test_small_readers(spark, tmp_path):
    assert [one(spark, rd.from_end(F.lit("a b c d"), " ", k))[0] for k in (1, 2)] == ["d", "c"]
    text = b"id\tx1\tx2\tlast\nr1\t1\t2\t9\nr2\t1\t8\n"
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in.tsv")
        info.size = len(text)
        t.addfile(info, io.BytesIO(text))
    (tmp_path / "kv.txt").write_text("a\t1\nb\tx y\n")
    assert sorted(map(tuple, rd.key_values(spark, f"file://{tmp_path}/kv.txt").collect())) == [("a", "1"), ("b", "x y")]
    spark.range(100).selectExpr("id", "id % 7 AS k").write.parquet(f"{tmp_path}/p")
    some = rd.members_only(spark, f"{tmp_path}/p", "k", [2, 5])
    assert some.count() == sum(i % 7 in (2, 5) for i in range(100))
    assert "PushedFilters: [In(k" in some._jdf.queryExecution().toString() or "In(k" in some._jdf.queryExecution().toString()


def test_joins(spark):
    kind = "p long, a string, b string, k string"
    left = spark.createDataFrame([(1, "A", "C", "l1"), (2, "G", "T", "l2"), (3, "A", "C", "l3")], kind)
    right = spark.createDataFrame([(1, "C", "A", "r1"), (2, "G", "T", "r2"), (3, "A", "G", "r3"), (3, "C", "A", "r4")], "p long, a string, b string, r string")
    assert sorted((x.k, x.r) for x in jn.unordered(left, right, ["p"], ("a", "b")).collect()) == [("l1", "r1"), ("l2", "r2"), ("l3", "r4")]
    assert sorted((x.k, x.r, x.allele_status) for x in jn.position_check(left, right, ["p"], ("a", "b")).collect()) == [("l1", "r1", "swapped"), ("l2", "r2", "same"), ("l3", "r3", "mismatch"), ("l3", "r4", "swapped")]
    a, b = (spark.createDataFrame([(i, k) for i, k in enumerate(ks)], "i long, k string") for ks in ("abcd", "abd"))
    assert [tuple(r) for r in jn.same_order(a, b, "i", "k").orderBy("rank").collect()] == [(2, "c", "d"), (3, "d", None)]
    assert jn.same_order(a, a, "i", "k").count() == 0


def test_allele_counts_and_block_ratios(spark):
    cells = spark.createDataFrame([("v", 1, None, 0.9), ("v", 2, 2, 1.8), ("v", None, 0, None), ("w", None, None, None)], "v string, gt int, gp int, ds double")
    got = {r.v: r for r in ag.allele_counts(cells, ["v"], F.col("gt"), F.col("gp"), F.col("ds")).collect()}
    v = got["v"]
    assert (v.ac_gt, v.an_gt, v.af_gt, v.ac_gp, v.an_gp, v.an_ds) == (3, 4, 0.75, 2, 4, 4) and v.af_ds == pytest.approx(2.7 / 4)
    assert got["w"].an_gt == 0 and got["w"].af_gt is None
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), float(d), float(r)) for a, b, d, r in zip(rng.integers(0, 2, 200), rng.integers(0, 2, 200), rng.random(200) * 10, rng.random(200))]
    df = spark.createDataFrame(rows, "a int, b int, d double, r double")
    for x in ag.block_r2_by_distance(df, "a", "b", "d", "r", [0.0, 5.0, 10.0]).collect():
        own = [r for r in rows if (r[2] >= 5) == (x.bin == 1)]
        same, other = ([r[3] for r in own if (r[0] == r[1]) == k] for k in (True, False))
        assert x.same == pytest.approx(np.median(same)) and x.other == pytest.approx(np.median(other)) and x.n_same == len(same) and x.ratio == pytest.approx(np.median(same) / np.median(other))


def design(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 1 + x @ [0.5, -1.0, 0.0] + rng.normal(size=n) * (0.5 + np.abs(x[:, 0]))
    return x, y


def test_linear_models(spark):
    x, y = design()
    df = spark.createDataFrame([(*map(float, r), float(v), int(v > 1), k % 5) for k, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, y double, z int, fold int").repartition(4)
    names, full = ["a", "b", "c"], np.column_stack([np.ones(len(x)), x])
    for p, beta in ln.ridge(df, names, "y", [0.0, 5.0]).items():
        free = np.diag([0.0, 1, 1, 1]) * p
        assert np.allclose(beta, np.linalg.solve(full.T @ full + free, full.T @ y))
    hc = ln.hc3_t(df, names, "y")
    inv = np.linalg.inv(full.T @ full)
    e = (y - full @ (inv @ full.T @ y)) / (1 - np.einsum("ij,jk,ik->i", full, inv, full))
    assert np.allclose(hc.se, np.sqrt(np.diag(inv @ (full.T * e**2) @ full @ inv)))
    g = full.T @ full
    whole = np.column_stack([full, y])
    beta = ln.elastic_net(whole.T @ whole, 0.1, 0.7)
    score = full.T @ (y - full @ beta) / len(y)
    assert abs(score[0]) < 1e-8
    for b, s in zip(beta[1:], score[1:]):  # the subgradient holds
        assert abs(s - 0.03 * b - 0.07 * np.sign(b)) < 1e-7 if b else abs(s) <= 0.07 + 1e-8
    z = (y > 1).astype(float)
    beta = ln.logistic(df, names, "z", penalty=0.5)
    p = 1 / (1 + np.exp(-full @ beta))
    assert np.allclose(full.T @ (z - p) - np.diag([0, 0.5, 0.5, 0.5]) @ beta, 0, atol=1e-5)
    scored = df.withColumn("p", 1 / (1 + F.exp(-2 * (F.col("b") + 0.3))))
    out = ln.calibrated(scored, "p", "z").agg(F.sum(F.col("z") - F.col("calibrated")), F.sum((F.col("z") - F.col("calibrated")) * F.col("b"))).first()
    assert abs(out[0]) < 1e-4 and abs(out[1]) < 1e-4
    errors = ln.cross_validated(df, names, "y", "fold", [0.0, 10.0, 1e6])
    fold = np.arange(len(y)) % 5
    for r in errors.itertuples():
        tr = fold != r.fold
        b = np.linalg.solve(full[tr].T @ full[tr] + np.diag([0.0, 1, 1, 1]) * r.penalty, full[tr].T @ y[tr])
        assert r.sse == pytest.approx(((y[~tr] - full[~tr] @ b) ** 2).sum())
    per = errors.assign(m=errors.sse / errors.n).groupby("penalty").m.agg(["mean", "sem"])
    best = per["mean"].min() + per.loc[per["mean"].idxmin(), "sem"]
    assert ln.one_standard_error(errors) == per.index[per["mean"] <= best].max()
    gain = ln.pooled_gain(df, ["c"], ["a", "b"], "y", "fold", 1.0)
    sse = [ln.cross_validated(df, c, "y", "fold", [1.0]).sse.sum() for c in (["c"], ["c", "a", "b"])]
    assert gain == pytest.approx((sse[0] - sse[1]) / ((y - y.mean()) ** 2).sum()) and g.shape == (4, 4)
    assert st.r_squared(df.withColumn("f", F.lit(1.0) + 0.5 * F.col("a") - F.col("b")), "y", "f").first()[0] == pytest.approx(1 - ((y - full @ [1, 0.5, -1, 0]) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_mixture_and_power(spark):
    rng = np.random.default_rng(5)
    t2 = np.where(rng.random(8000) < 0.2, 9.0, 1.0) * rng.chisquare(1, 8000)
    share, scale = st.mixture_em(spark.createDataFrame([(float(v),) for v in t2], "t double"), "t", 200)
    assert abs(share - 0.2) < 0.05 and abs(scale - 9) < 2
    got = {(r.effect, r.n): r.power for r in st.power_grid([0.0, 0.3], [50, 100], 4000, 1, spark).collect()}
    for (effect, n), power in got.items():
        shift = effect * math.sqrt(n)
        tail = lambda v: 0.5 * math.erfc(v / math.sqrt(2))
        assert abs(power - tail(1.959964 - shift) - tail(1.959964 + shift)) < 0.03


def test_dimension_and_tendency(spark):
    rng = np.random.default_rng(6)
    plane = np.column_stack([rng.random((500, 2)), np.zeros((500, 2))]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(plane)], "id long, v array<double>")
    near = nearest_neighbours(df, "id", "v", 10).cache()
    d = np.sqrt(((plane[:, None] - plane[None]) ** 2).sum(-1))
    t = np.sort(d, 1)[:, 1:11]
    assert cl.likelihood_dimension(near, 10).first().dimension == pytest.approx(1 / (np.log(t[:, 9:] / t[:, :9]).sum(1) / 9).mean())
    assert 1.7 < cl.intrinsic_dimension(near).first().dimension < 2.4 and 1.7 < cl.likelihood_dimension(near, 10).first().dimension < 2.4
    assert cl.likelihood_dimension(near.where("query_id < 19"), 10).first().dimension is None
    blobs = np.concatenate([rng.normal(c, 0.02, (40, 2)) for c in (0, 5, 9)])
    for points, low, high in ((blobs, 0.85, 1.0), (rng.random((120, 2)), 0.3, 0.75)):
        rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(points)], "id long, v array<double>")
        assert low < cl.hopkins(rows, "id", "v", 25) <= high
    values = np.concatenate([rng.normal(0, 1, 400), rng.normal(8, 1, 400)])
    rows = [("two", float(v)) for v in values] + [("one", float(v)) for v in values[:400]] + [("few", 1.0), ("same", None)] + [("flat", 2.0)] * 40
    got = {r.g: r.coefficient for r in cl.bimodality(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    n, c = len(values), values - values.mean()
    skew, kurt = (c**3).mean() / c.var() ** 1.5, (c**4).mean() / c.var() ** 2 - 3
    assert got["two"] == pytest.approx((skew**2 + 1) / (kurt + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))) and got["two"] > 5 / 9 > got["one"]
    assert got["few"] is None and got["flat"] is None and "same" not in got


def test_resampling(spark):
    df = spark.range(400).selectExpr("id", "CAST(id AS double) AS v")
    means = rs.bootstrap_means(df, "id", "v", 60, "s").cache()
    assert means.count() == 60 and means.agg(F.stddev("mean")).first()[0] == pytest.approx(math.sqrt(400**2 / 12 / 400), rel=0.4)
    lo, hi = rs.percentile_interval(means, "mean", 0.9).first()
    v = [r["mean"] for r in means.collect()]
    assert (lo, hi) == (pytest.approx(np.quantile(v, 0.05)), pytest.approx(np.quantile(v, 0.95)))
    parts = df.select("id", rs.split_by_hash("id", "s", [("train", 0.6), ("valid", 0.2), ("test", 0.2)]).alias("p"))
    sizes = {r.p: r["count"] for r in parts.groupBy("p").count().collect()}
    assert set(sizes) == {"train", "valid", "test"} and abs(sizes["train"] - 240) < 45
    assert {r.id: r.p for r in parts.where("id < 50").collect()} == {r.id: r.p for r in df.where("id < 50").select("id", rs.split_by_hash("id", "s", [("train", 0.6), ("valid", 0.2), ("test", 0.2)]).alias("p")).collect()}
    blocks = spark.createDataFrame([(k, 10 * (k + 1), k) for k in range(5)], "k long, len long, o long")
    placed = rs.block_placement(blocks, "k", "len", "o", 1000.0, 30, "s").toPandas().sort_values(["rep", "start"])
    assert np.allclose(placed.end - placed.start, 10 * (placed.k + 1)) and placed.start.min() >= 0 and placed.end.max() <= 1000
    for _, own in placed.groupby("rep"):
        assert own.k.tolist() == list(range(5)) and (own.start.to_numpy()[1:] >= own.end.to_numpy()[:-1] - 1e-9).all()


def test_leaders_clusters_and_distances(spark):
    nodes = spark.createDataFrame([("g", k, float(k)) for k in range(6)], "g string, key long, o double")
    edges = spark.createDataFrame([("g", 0, 2, 0.9), ("g", 1, 2, 0.95), ("g", 2, 3, 0.99), ("g", 4, 5, 0.5)], "g string, a long, b long, r2 double")
    assert {r.key: r.leader for r in cl.leaders(edges, nodes, ["g"], "key", "o").collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5}
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in (0, 3, 6)] + [[[20.0, 20.0]]])
    df = spark.createDataFrame([("g", i, [float(v) for v in r]) for i, r in enumerate(x)], "g string, key long, v array<double>")
    truth = [i // 12 for i in range(36)]
    got = {r.key: r.cluster for r in cl.average_linkage(df.where("key < 36"), ["g"], "key", "v", 3).collect()}
    assert [got[i] for i in range(36)] == truth
    got = {r.key: r.cluster for r in cl.dbscan(df, ["g"], "key", "v", 1.0, 4).collect()}
    assert [got[i] for i in range(37)] == [*truth, -1]
    k, out = cl.gaussian_mixture(df.where("key < 36"), "v", [2, 3, 4])
    labels = {r.key: r.cluster for r in out.collect()}
    assert k == 3 and all(len({labels[i] for i in range(36) if truth[i] == t}) == 1 for t in range(3))
    tags = spark.createDataFrame([("g", 1, ["a", "b"], "x", 0.0), ("g", 2, ["b", "c"], "x", 0.5), ("g", 3, [], "y", 1.0)], "g string, key long, t array<string>, c string, n double")
    got = {(r.a, r.b): r.distance for r in cl.mixed_distance(tags, ["g"], "key", "t", "c", ["n"]).collect()}
    assert got[1, 2] == pytest.approx((1 - 1 / 3 + 0 + 0.5) / 3) and got[1, 3] == pytest.approx((1 + 1 + 1) / 3)


def test_haplotype_units(spark):
    pairs = spark.createDataFrame([("t", i, j) for i in range(5) for j in range(i)] + [("u", 1, 0)], "tile string, a long, b long")
    some = rs_sorted(hp.select_pairs(pairs, ["tile"], ["a", "b"], 4, "s"))
    assert len([r for r in some if r[0] == "t"]) == 4 and some == rs_sorted(hp.select_pairs(pairs.repartition(7), ["tile"], ["a", "b"], 4, "s"))
    counts = spark.createDataFrame([("p", "w", "00", 1), ("p", "w", "01", 1), ("q", "w", "11", 2)], "person string, w string, state string, n int")
    dictionary = spark.createDataFrame([("w", "00", 1), ("w", "01", 2)], "w string, state string, rank int")
    assert {(r.person, r.state): r.level for r in hp.two_level(counts, dictionary, "w").collect()} == {("p", "00"): "major", ("p", "01"): "rest", ("q", "11"): "rest"}
    assert {r.state for r in hp.without_reference(counts, dictionary, "w").collect()} == {"01", "11"}
    members = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), ("b", None)], "team string, v double")
    assert {r.team: (r["mean"], r["max"], r.n) for r in hp.member_summary(members, "team", "v").collect()} == {"a": (2.5, 4.0, 2), "b": (None, None, 0)}
    markers = spark.createDataFrame([("1", p) for p in range(0, 1000, 10)], "c string, pos long")
    got = hp.units(spark.createDataFrame([("1", 500)], "c string, pos long"), markers, ["c"], "pos", 30.0, "s").collect()
    kinds = pd.Series([r.kind for r in got]).value_counts()
    assert sorted(r.member for r in got if r.kind == "WINDOW") == [470, 480, 490, 510, 520, 530] and kinds["TARGET"] == 1 and 1 <= kinds["NEIGHRND"] <= 6


def test_exact_sums_of_any_size(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), [5e-324] * 3, [1e16, 1.0, -1e16]])
    rows = [("a", float(v)) for v in values] + [("b", 0.1)] * 10 + [("b", None), ("b", float("nan"))] + [("i", float("inf")), ("i", 1.0), ("n", float("inf")), ("n", float("-inf")), (None, 2.0), ("z", 0.0)]
    got = {r.g: r.total for r in ag.exact_sum(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v").collect()}
    assert got["a"] == math.fsum(values) and got["b"] == math.fsum([0.1] * 10)
    assert got["i"] == math.inf and got["n"] is None and got[None] == 2.0 and got["z"] == 0.0


def rs_sorted(df):
    return sorted(map(tuple, df.collect()))

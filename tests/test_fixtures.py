"""Small literal tables with results worked out by hand: keys, dosages, phases, floors, weights, intervals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.functions import columns as col
from strandset.operators import aggregates as ag
from strandset.operators import association as st
from strandset.operators import clustering as cl
from strandset.operators import haplotypes as hp
from strandset.operators import intervals as iv
from strandset.operators import joins as jn
from strandset.operators import ranking as rk
from strandset.operators import resampling as rs

PHASES = "tile string, h1j int, h2j int, h1k int, h2k int"


def one(spark, *exprs):
    return spark.range(1).select(*exprs).first()


def test_keys_alleles_and_orientation(spark):
    rows = [("1:100:A:C",), ("chr2:5:a:g",), ("1:100.0:A:C",), ("1:100:A:A",), ("1:100:A",), (None,)]
    got = [r.k for r in spark.createDataFrame(rows, "key string").select(col.parse_key(F.col("key")).alias("k")).collect()]
    assert [tuple(k) if k else None for k in got] == [("1", 100, "A", "C"), ("2", 5, "A", "G"), None, None, None, None]
    pairs = [("A", "C", "A", "C"), ("A", "C", "C", "A"), ("A", "C", "T", "G"), ("A", "C", "G", "T"), ("A", "C", "A", "G")]
    got = [r.o for r in spark.createDataFrame(pairs, "a string, b string, c string, d string").select(col.orientation(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("o")).collect()]
    assert [tuple(o) if o else None for o in got] == [(1, "direct"), (-1, "swap"), (1, "rc"), (-1, "swap_rc"), None]
    r = one(spark, col.palindromic(F.lit("A"), F.lit("t")).alias("p"), col.palindromic(F.lit("A"), F.lit("C")).alias("n"), col.complement(F.lit("ACGTN")).alias("rc"), col.strip_version(F.lit("ENSG1.12")).alias("v"), col.normalise_id(F.lit("a_a")).alias("i"), col.normalise_id(F.lit("x_y_z")).alias("j"), col.variant_key(F.lit("chr3"), F.lit(7), F.lit("a"), F.lit("t")).alias("k"))
    assert tuple(r) == (True, False, "NACGT", "ENSG1", "a", "z", "3:7:A:T")


def test_dosages_follow_the_rarer_allele(spark):
    r = one(spark, col.minor_dosage(F.lit(1.8), F.lit(0.9)).alias("a"), col.minor_dosage(F.lit(1.8), F.lit(0.1)).alias("b"), col.minor_alleles(F.array(F.lit(0), F.lit(1), F.lit(-1)), F.lit(0.7)).alias("c"), col.folded(F.lit(0.75)).alias("d"), col.folded_count(F.lit(15), F.lit(10)).alias("e"), col.dosage_variance(F.lit(0.5), F.lit(0.8)).alias("f"))
    assert math.isclose(r.a, 0.2) and r.b == 1.8 and r.c == [1, 0, -1] and (r.d, r.e) == (0.25, 5) and math.isclose(r.f, 0.4)


def test_hard_calls(spark):
    r = one(spark, col.hard_call(F.array(F.lit(0.05), F.lit(0.92), F.lit(0.03))).alias("a"), col.hard_call(F.array(F.lit(0.05), F.lit(0.89), F.lit(0.06))).alias("b"), col.call_from_gt(F.lit("0|1")).alias("c"), col.call_from_gt(F.lit("./.")).alias("d"), col.call_from_gt(F.lit("1/1")).alias("e"))
    assert tuple(r) == (1, None, 1, None, 2)


def test_cis_and_trans_phase_pairs(spark):
    rows = [("cis", 1, 0, 1, 0), ("cis", 0, 1, 0, 1), ("trans", 1, 0, 0, 1), ("hom", 1, 1, 1, 0), ("missing", -1, 0, 1, 0)]
    df = spark.createDataFrame(rows, PHASES)
    q = {r.tile: r.q for r in df.select("tile", col.phase_product(F.col("h1j"), F.col("h2j"), F.col("h1k"), F.col("h2k")).alias("q")).collect()}
    assert q["cis"] > 0 and q["trans"] < 0 and q["hom"] == 0
    # exchanging both copies changes nothing
    swapped = df.select("tile", F.col("h2j").alias("h1j"), F.col("h1j").alias("h2j"), F.col("h2k").alias("h1k"), F.col("h1k").alias("h2k"))
    key = lambda d: sorted(map(tuple, hp.pair_support(d, ["tile"], ("h1j", "h2j", "h1k", "h2k")).collect()))
    assert key(df) == key(swapped)
    got = {r.tile: r for r in hp.pair_support(df, ["tile"], ("h1j", "h2j", "h1k", "h2k")).collect()}
    assert (got["cis"].n_cis, got["cis"].n_trans, got["trans"].n_trans, got["hom"].n_double_het, got["missing"].n_known) == (2, 0, 1, 0, 0)


def test_unseen_and_missing_states_are_other(spark):
    a = spark.createDataFrame([(p, c, 0, s) for p in range(3) for c, s in enumerate(("01", "10"))] + [(9, 0, 0, "0."), (9, 1, 0, "11")], "person int, copy int, w int, state string")
    dictionary = hp.state_dictionary(a, "w", "person", least_people=2, most=8)
    assert {r.state for r in dictionary.collect()} == {"01", "10"}
    b = spark.createDataFrame([(1, 0, 0, "01"), (1, 1, 0, "00"), (2, 0, 0, "1."), (2, 1, 0, "1.")], "person int, copy int, w int, state string")
    got = {(r.person, r.state): r.n for r in hp.state_counts(b, dictionary, "person", "w").collect()}
    assert got == {(1, "01"): 1, (1, "OTHER"): 1, (2, "OTHER"): 2}
    assert one(spark, hp.encode(F.array(F.lit(0), F.lit(1), F.lit(-1))).alias("e")).e == "01."
    # names of states do not matter: relabelled states give the same counts
    swap = F.when(F.col("state") == "01", "x").when(F.col("state") == "10", "y").otherwise(F.col("state"))
    again = {(r.person, r.n) for r in hp.state_counts(b.withColumn("state", swap), dictionary.withColumn("state", swap), "person", "w").collect()}
    assert again == {(k[0], n) for k, n in got.items()}


def test_ratio_of_sums_is_not_the_mean_of_ratios(spark):
    df = spark.createDataFrame([("a", 8.0, 10.0), ("a", 1.0, 1.0), ("b", 1.0, 10.0)], "chrom string, num double, den double")
    whole = ag.ratio_of_sums(df, [], "num", "den").first().ratio
    each = [r.ratio for r in ag.ratio_of_sums(df, ["chrom"], "num", "den").collect()]
    assert math.isclose(whole, 10 / 21) and abs(whole - sum(each) / 2) > 0.01


def test_credible_set_weights(spark):
    df = spark.createDataFrame([(0, "r", "1", 0.2), (0, "r", "1", 0.02), (0, "r", "x", 0.5), (0, "r", "y", 0.001)], "trait int, region string, cs string, y double")
    got = [r.weight for r in ag.block_balanced_weights(df.withColumn("k", F.lit("all")), ["trait", "region", "cs"], ["k"]).orderBy("y").collect()]
    assert all(w > 0 for w in got) and math.isclose(got[0], 2 * got[1]) and math.isclose(got[3], 2 * got[2])


def test_soft_cross_entropy_is_finite_at_the_ends(spark):
    df = spark.createDataFrame([(0.25, 0.3), (0.8, 0.9), (0.0, 1.0), (1.0, 0.0)], "p double, y double")
    got = [r.c for r in df.select(st.soft_cross_entropy(F.col("p"), F.col("y")).alias("c")).collect()]
    want = [-(y * math.log(p) + (1 - y) * math.log(1 - p)) for p, y in ((0.25, 0.3), (0.8, 0.9))]
    assert np.allclose(got[:2], want) and all(math.isfinite(g) for g in got)


def test_step_up_is_not_pointwise(spark):
    df = spark.createDataFrame([(p,) for p in (0.011, 0.012, 0.014, 0.9)], "p double")
    assert rk.bh_rejections(df, "p", 0.02).first().n_rejected == 3
    assert rk.bh_rejections(df, "p", 0.02, "pointwise").first().n_rejected == 1
    with_null = spark.createDataFrame([(0.01,), (0.04,), (0.04,), (None,), (1.0,)], "p double")
    got = {(r.p, r.q) for r in rk.bh_adjusted(with_null, "p").collect()}
    assert {p: round(q, 6) for p, q in got if p is not None} == {0.01: 0.04, 0.04: round(0.16 / 3, 6), 1.0: 1.0} and (None, None) in got


def test_inflation_modes_differ(spark):
    df = spark.createDataFrame([((k + 0.5) / 1000,) for k in range(1000)], "p double")
    chi2, log = st.lambda_gc(df, "p").first()[0], st.lambda_gc(df, "p", "log_2df").first()[0]
    assert abs(chi2 - 1) < 0.01 and abs(log - 1) < 0.01
    skewed = df.select(F.pow("p", F.lit(2.0)).alias("p"))
    assert abs(st.lambda_gc(skewed, "p").first()[0] - st.lambda_gc(skewed, "p", "log_2df").first()[0]) > 0.1


def test_mixture_tails():
    # one weight: a scaled chi-square with one degree of freedom; equal weights: one with many
    for q, lam, want in ((3.841458820694124, [1.0], 0.05), (2 * 3.841458820694124, [2.0], 0.05), (18.307038053275146, [1.0] * 10, 0.05), (11.0705, [1.0] * 5, 0.05)):
        assert abs(st.mixture_tail(q, np.array(lam)) - want) < 1e-5
        assert abs(st.mixture_tail(q, np.array(lam), "exact") - want) < (1e-3 if len(lam) == 1 else 1e-5)
    lam = np.array([3.0, 1.5, 0.7, 0.2, 0.1])
    draws = (np.random.default_rng(1).chisquare(1, (400_000, 5)) * lam).sum(1)
    for q in (3.0, 8.0, 20.0):
        assert abs(st.mixture_tail(q, lam, "exact") - (draws > q).mean()) < 4e-3
        assert abs(st.mixture_tail(q, lam) - (draws > q).mean()) < 2.5e-2


def test_distance_to_half_open_intervals(spark):
    spans = [("1", 10, 20), ("1", 12, 15), ("1", 40, 50), ("1", 60, 60), ("2", 5, 6)]
    points = [("1", p) for p in (1, 10, 11, 20, 21, 25, 31, 40, 41, 50, 51, 99)] + [("2", 6), ("3", 1)]
    got = {(r.c, r.p): r.distance for r in iv.distance_to_interval(spark.createDataFrame(points, "c string, p long"), spark.createDataFrame(spans, "c string, s long, e long"), ["c"], "p", "s", "e", 16.0).collect()}
    for c, p in points:
        own = [(s, e) for k, s, e in spans if k == c and e > s]
        inside = any(s < p <= e for s, e in own)
        want = None if not own else 0 if inside else min([p - 1 - e + 1 for s, e in own if s <= p - 1] + [s - (p - 1) for s, e in own if s > p - 1])
        assert got[c, p] == want, (c, p)


def test_nearest_assignment_is_exclusive(spark):
    features = [("1", 10, "a"), ("1", 20, "b"), ("1", 20, "c"), ("1", 40, "d")]
    points = [("1", p) for p in (1, 15, 19, 20, 21, 30, 31, 99)]
    got = {r.p: (r.assigned, r.distance) for r in iv.assign_nearest(spark.createDataFrame(points, "c string, p long"), spark.createDataFrame(features, "c string, at long, g string"), ["c"], "p", "at", "g", 16.0).collect()}
    assert got == {1: ("a", 9), 15: ("a", 5), 19: ("b", 1), 20: ("b", 0), 21: ("c", 1), 30: ("c", 10), 31: ("d", 9), 99: ("d", 59)}


def test_merging_touching_and_adjacent(spark):
    df = spark.createDataFrame([("1", 0, 10), ("1", 10, 12), ("1", 14, 20), ("1", 3, 5), ("2", 1, 2)], "c string, s long, e long")
    merged = lambda gap: sorted((r.c, r.start, r.end, r.n) for r in iv.merge_intervals(df, ["c"], "s", "e", 8.0, gap).collect())
    assert merged(0) == [("1", 0, 12, 3), ("1", 14, 20, 1), ("2", 1, 2, 1)] and merged(2) == [("1", 0, 20, 4), ("2", 1, 2, 1)]


def test_regions_around_leads(spark):
    leads = spark.createDataFrame([("1", 1_000_000, 1e-9), ("1", 2_000_000, 1e-8), ("1", 6_000_000, 1e-10)], "c string, pos long, p double")
    got = sorted((r.start, r.n_leads, r.min_p) for r in iv.region_build(leads, ["c"], "pos", "p", 1_500_000, 1e6).collect())
    assert got == [(-500_000, 2, 1e-9), (4_500_000, 1, 1e-10)]


def test_exact_sum_loses_nothing(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-15, 15, 300), [1e100, 1.0, -1e100]])
    df = spark.createDataFrame([("g" if k % 2 else None, float(v)) for k, v in enumerate(rng.permutation(x))] + [("g", None)], "k string, v double").repartition(7)
    got = {r.k: r.total for r in ag.exact_sum(df, ["k"], "v").collect()}
    assert got == {k: math.fsum(r.v for r in df.where(F.col("k").eqNullSafe(k)).where("v IS NOT NULL").collect()) for k in ("g", None)}


def test_hub_goes_first_and_components(spark):
    star = spark.createDataFrame([(0, k) for k in range(1, 6)] + [(10, 11), (11, 12), (10, 12)], "src long, dst long")
    gone = [r.dropped for r in cl.prune_related(star, "src", "dst").collect()]
    assert 0 in gone and not set(gone) & set(range(1, 6)) and len(set(gone) & {10, 11, 12}) == 2
    assert {r.node: r.component for r in cl.components(star, "src", "dst").collect()} == {**{k: 0 for k in range(6)}, 10: 10, 11: 10, 12: 10}


def test_greedy_steps_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = [("g", k, int(rng.integers(0, 400)), float(rng.random())) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, k long, pos long, p double")
    lead = {}
    for _, k, pos, p in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        if k not in lead:
            lead.update({j: k for _, j, q, _ in rows if j not in lead and abs(q - pos) <= 25})
    assert {r.k: r.lead for r in cl.greedy_clump(df, ["g"], "k", "pos", "p", 25.0).collect()} == lead
    edges = [(a, b) for a in range(60) for b in range(a) if rng.random() < 0.08]
    linked = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    kept = []
    for _, k, _, p in sorted(rows, key=lambda r: (r[3], r[1])):
        if not any((k, j) in linked for j in kept):
            kept.append(k)
    e = spark.createDataFrame([("g", a, b) for a, b in edges], "g string, a long, b long")
    assert sorted(r.k for r in cl.greedy_prune(df, e, ["g"], "k", "p").collect()) == sorted(kept)


def test_quantiles_from_ranks(spark):
    rng = np.random.default_rng(4)
    rows = [(["a", "b", "c"][k % 3], float(np.round(rng.normal(), 1)) if k % 11 else None) for k in range(500)] + [("d", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    for r in rk.linear_quantiles(df, "v", probs, ["g"]).collect():
        assert np.allclose(r.q, np.quantile([v for g, v in rows if g == r.g and v is not None], probs))
    assert np.allclose(rk.linear_quantiles(df, "v", probs).first().q, np.quantile([v for _, v in rows if v is not None], probs))


def test_resampling_draws(spark):
    df = spark.createDataFrame([(k, k % 3, float(k), float(-k)) for k in range(40)], "k long, g int, x double, y double")
    out = rs.column_shuffle(df, "k", [["x"], ["y"]], "s").collect()
    assert sorted(r.x for r in out) == [float(k) for k in range(40)] == sorted(-r.y for r in out) and any(r.x != -r.y for r in out)
    thin = [r.k for r in rs.thinned(df.where("g = 0"), ["g"], ["k"], 5).orderBy("k").collect()]
    assert thin == [0, 9, 21, 30, 39]
    perm = rs.permute_within(df, ["g"], "k", "x", 3, "s").collect()
    for rep in range(3):
        for g in range(3):
            own = [r for r in perm if r.rep == rep and r.g == g]
            assert sorted(r.permuted for r in own) == sorted(r.x for r in own)


def test_shifted_intervals_keep_their_lengths(spark):
    df = spark.createDataFrame([("1", 5, 9), ("2", 50, 80)], "c string, s long, e long")
    got = iv.shifted_null(df, ["c"], "s", "e", {"1": 100.0, "2": 500.0}, 4, "n").collect()
    assert len(got) == 8 and all(r.e - r.s == {"1": 4, "2": 30}[r.c] and 0 <= r.s < {"1": 100, "2": 500}[r.c] for r in got)


def test_cardinality_is_checked(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k long, w string")
    with pytest.raises(Exception):
        jn.validated_join(a, b, ["k"], "1:1").collect()


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(k), float(2 * k)) for k in range(300)], "c double, x double, y double")
    got = {(r.a, r.b): r.r for r in ag.correlations(df, ["c", "x", "y"]).collect()}
    assert all(v is None or math.isnan(v) for k, v in got.items() if "c" in k and k[0] != k[1])
    assert math.isclose(next(v for k, v in got.items() if set(k) == {"x", "y"}), 1.0)
    flat = spark.createDataFrame([("a", 1.0, float(k)) for k in range(9)] + [("b", float(k), float(-k)) for k in range(9)], "g string, x double, y double")
    rho = {r.g: r.rho for r in st.spearman(flat, "x", "y", ["g"]).collect()}
    assert rho["a"] is None and math.isclose(rho["b"], -1.0)


def test_effective_rank_from_products(spark):
    rng = np.random.default_rng(6)
    x = {g: rng.normal(size=(30, 5)) * [3, 2, 1, 0.1, 0] + 7 for g in (0, 1)}
    x[2] = np.ones((4, 5))
    df = spark.createDataFrame([(g, [float(v) for v in row]) for g, m in x.items() for row in m], "g int, v array<double>").repartition(5)
    for r in st.effective_rank(df, "g", "v").collect():
        s = np.linalg.svd(x[r.g] - x[r.g].mean(0), compute_uv=False)
        s = s[s > 1e-9]
        p = s / s.sum()
        assert (r.effective_rank is None) == (r.g == 2) and (r.g == 2 or math.isclose(r.effective_rank, np.exp(-(p * np.log(p)).sum()), rel_tol=1e-6))


def test_nearest_neighbours_in_many_blocks(spark):
    from strandset.operators import sets as se

    x = np.random.default_rng(8).normal(size=(60, 3)).round(1)
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "k long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for rows in (20_000, 7):
        got = {}
        for r in se.nearest_neighbours(df, "k", "v", 3, block_rows=rows).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.distance
        for i in range(60):
            assert np.allclose([got[i][k] for k in (1, 2, 3)], np.sort(np.delete(d[i], i))[:3], atol=1e-6)


def test_pairs_of_a_large_group_are_dealt(spark):
    rng = np.random.default_rng(9)
    rows = [(int(p), int(v), "ab"[v % 2]) for p in range(4) for v in rng.permutation(40)[: 30 if p else 40]]
    df = spark.createDataFrame(rows, "p long, v long, g string")
    left, right = jn.dealt_sides(df, ["p"], "v", part_rows=7)
    assert left.groupBy("p", "_deal").count().agg(F.max("count")).first()[0] < 30 and right.count() > left.count() == len(rows)
    want = {}
    for p, v, g in rows:
        for q, w, h in rows:
            if p == q and g == h and v < w:
                want[g, v, w] = want.get((g, v, w), 0) + 1
    assert {(r.g, r.a, r.b): r.n_common for r in jn.pairs_within(df, ["p"], "v", ["g"]).collect()} == want
    dealt = left.withColumnRenamed("v", "a").join(right.withColumnRenamed("v", "b").drop("g"), ["p", "_deal"]).where("a < b").count()
    assert dealt == sum(n * (n - 1) // 2 for n in [40, 30, 30, 30])

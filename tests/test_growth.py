"""Steps whose memory or time must not grow with the table, against plain versions."""

import itertools
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandset.operators import joins as jn
from strandset.operators import linkage as lk
from strandset.operators import resampling as rs
from strandset.operators import sets as se
from strandset.plans import relational


def test_permutations_are_joined_by_sorting(spark):
    df = spark.createDataFrame([(k % 3, k, float(k)) for k in range(300)], "g long, id long, x double")
    out = rs.permute_within(df, ["g"], "id", "x", 4, "s")
    assert "SortMergeJoin" in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert len(rows) == 1200 and all(r.permuted % 3 == r.g for r in rows)
    for rep, g in itertools.product(range(4), range(3)):
        own = [r for r in rows if (r.rep, r.g) == (rep, g)]
        assert sorted(r.permuted for r in own) == sorted(r.x for r in own) and [r.permuted for r in own] != [r.x for r in own]


def test_pairs_at_a_place_are_counted_without_making_them(spark):
    n = 40_000  # 800 million pairs
    left = spark.range(n).select((F.col("id") % 2).alias("place"), F.lit("A").alias("ref"), F.when(F.col("id") % 5 == 0, "T").otherwise("C").alias("alt"))
    right = spark.range(n).select((F.col("id") % 2).alias("place"), F.when(F.col("id") % 4 < 2, "A").otherwise("C").alias("ref"), F.when(F.col("id") % 4 < 2, "C").otherwise("A").alias("alt"))
    args = (["place"], ("ref", "alt"))
    got = {r.allele_status: r.n for r in jn.position_counts(left, right, *args).collect()}
    half = n // 2
    assert got == {"same": 2 * (half * 4 // 5) * (half // 2), "swapped": 2 * (half * 4 // 5) * (half // 2), "mismatch": 2 * (half // 5) * half}
    few = [side.limit(60) for side in (left, right)]
    plain = {r.allele_status: r.n for r in jn.position_check(*few, *args).groupBy("allele_status").agg(F.count("*").alias("n")).collect()}
    assert {r.allele_status: r.n for r in jn.position_counts(*few, *args).collect()} == plain


def test_nearest_neighbours_of_copies_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(se, "CELLS", 100)
    monkeypatch.setattr(se, "CANDIDATES", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5)).astype(np.float32) * 1000
    x[10:30] = x[10]  # copies
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<float>")
    rows = se.nearest_neighbours(df, "id", "e", 4, df.where("id % 3 = 0"), block_rows=20).collect()
    want = {}
    for q in range(0, 90, 3):
        d = np.sqrt(((x[q].astype(float) - x.astype(float)) ** 2).sum(1))
        want[q] = sorted((d[j], j) for j in range(90) if j != q)[:4]
    assert len(rows) == 120
    for r in rows:
        assert (r.distance, r.neighbour) == want[r.query_id][r.rank - 1]


def plain_merges(x, weight):
    centre, mass, alive = x.copy(), weight.astype(float).copy(), np.ones(len(x), bool)
    merges, chain = [], []
    for _ in range(len(x) - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            top = chain[-1]
            d = ((centre - centre[top]) ** 2).sum(1) * (mass * mass[top] / (mass + mass[top]))
            d[~alive] = np.inf
            d[top] = np.inf
            near = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((float(d[near]), a, b))
        total = mass[a] + mass[b]
        centre[a] = (mass[a] * centre[a] + mass[b] * centre[b]) / total
        mass[a], alive[b] = total, False
    return merges


def test_ward_takes_few_distances_and_the_same_merges():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[40:60] = x[40]
    for mass in (np.ones(300), rng.integers(1, 5, 300).astype(float)):
        assert lk.ward_merges(x, mass) == plain_merges(x, mass)
    touched = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            got = super().__getitem__(at)
            if getattr(got, "ndim", 0) == 2 and isinstance(at, np.ndarray) and at.dtype != bool:
                touched.append(len(got))
            return got

    lk.ward_merges(x.view(Counted), np.ones(300))
    assert touched and sum(touched) < 20 * len(touched)


def test_pairs_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(jn, "task_count", lambda spark, pairs: 8 + int(pairs) // 100)
    rows = [(k % 20, k) for k in range(400)] + [(21, k) for k in range(0, 60)] + [(21, 3)]
    out = jn.pairs_within(spark.createDataFrame(rows, "g long, i long"), ["g"], "i")
    assert out.rdd.getNumPartitions() > 40
    want = Counter(p for g in {g for g, _ in rows} for p in itertools.combinations(sorted({i for h, i in rows if h == g}), 2))
    assert {(r.a, r.b): r.n_common for r in out.collect()} == want


def test_sources_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relational, "task_count", lambda spark, rows: int(rows) // 10)
    rows = [(k % 7, k % 3, k % 5 / 100.0) for k in range(400)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = relational.source_consistency(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 40
    got = {r.l_partkey: r for r in out.collect()}
    assert len(got) == 7 and all(r.n_sources == 3 and r.first_value == 0.0 and r.differs == 0 for r in got.values())

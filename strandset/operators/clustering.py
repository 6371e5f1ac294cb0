"""Components, greedy pruning and clumping, blocks and clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import settle


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with the least ``v`` of each ``u`` as ``m``; a node with more than a
    500th of the rows goes by broadcast (at most 1,000 are), so no task gets all its rows."""
    least = settle(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    heavy = F.col("n") > max(64, total // 500)
    if least.where(heavy).isEmpty():
        return rows.join(least.drop("n"), "u")
    few = F.broadcast(least.where(heavy).drop("n"))
    rest = rows.join(few.select("u"), "u", "left_anti").join(least.where(~heavy).drop("n"), "u")
    return rows.join(few, "u").unionByName(rest)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (least node) by alternating large-star and small-star steps."""
    links = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        n = links.count()
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(_with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        moved = _with_least(large, n)
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.where("v = m").select("u", "v"))
        new = settle(small.where("u <> v").distinct())
        changed = new.join(links, ["u", "v"], "left_anti").limit(1).count() or links.join(new, ["u", "v"], "left_anti").limit(1).count()
        links = new
        if not changed:
            break
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _per_group(df: DataFrame, group: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(*group).applyInPandas(step, schema)


def _fields(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def greedy_clump(df: DataFrame, group: list[str], key: str, pos: str, p: str, reach: float) -> DataFrame:
    """Each row's lead: most significant first, a row goes to the first lead within reach.

    Rows on both sides of a gap wider than ``reach`` cannot meet, so each stretch without
    such a gap is one task's group.
    """
    from .intervals import merge_intervals, point_in_interval

    width = 64.0 * reach
    points = df.select(*group, F.col(pos).alias("_lo"), F.col(pos).alias("_hi"))
    stretches = merge_intervals(points, group, "_lo", "_hi", width, gap=reach).select(*group, F.col("start").alias("_stretch"), F.col("end").alias("_until"))
    df = point_in_interval(df.select(*dict.fromkeys([*group, key, pos, p])), stretches, group, pos, "_stretch", "_until", width, "both")

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([p, pos, key], kind="stable").reset_index(drop=True)
        at, lead = pdf[pos].to_numpy(float), np.full(len(pdf), -1)
        for i in range(len(pdf)):
            if lead[i] < 0:
                lead[(lead < 0) & (np.abs(at - at[i]) <= reach)] = i
        return pdf[group + [key]].assign(lead=pdf[key].to_numpy()[lead], is_lead=(lead == np.arange(len(pdf))).astype(int))

    schema = f"{_fields(df, *group, key)}, lead {df.schema[key].dataType.simpleString()}, is_lead long"
    return _per_group(df.drop("_until"), [*group, "_stretch"], step, schema)


def greedy_ld_clump(df: DataFrame, edges: DataFrame, group: list[str], key: str, p: str, lead_p: float | None = None, member_p: float | None = None) -> DataFrame:
    """``group, key, lead, is_lead``: by increasing p, a row that no lead has taken leads and takes its neighbours (``group, a, b``).

    The outcome of the row-by-row loop without the loop: a row is decided once its better
    neighbours are.  A round finds all rows without an undecided better neighbour, which
    lead, and takes out their neighbours; edges between decided rows go.  Rounds are joins
    over the edges left, so no group meets in one task.  Rows above ``lead_p`` cannot lead,
    rows above ``member_p`` do not take part; rows that neither lead nor are taken are left
    out.  Equal p go by key, null p last.
    """
    rows = df.select(*group, F.col(key).alias("_k"), F.coalesce(F.col(p).cast("double"), F.lit(float("inf"))).alias("_p"))
    rows = settle(rows.where(F.col("_p") <= member_p) if member_p is not None else rows)
    can = F.col("_p") <= lead_p if lead_p is not None else F.lit(True)
    sides = [rows.select(*group, F.col("_k").alias(n), F.struct("_p", F.col("_k").alias("_i")).alias(f"_{n}")) for n in ("a", "b")]
    links = edges.select(*group, "a", "b").where("a <> b").join(sides[0], [*group, "a"]).join(sides[1], [*group, "b"])
    near = links.select(*group, F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")).distinct()
    near = settle(near.where(F.col("u._p") <= lead_p) if lead_p is not None else near)
    # edges from a row that may still lead to a worse one
    open_, taken, node = near, None, [*group, "v"]
    while not open_.isEmpty():
        worse = open_.select(*group, F.col("v").alias("u")).distinct()
        heads = open_.select(*group, "u").distinct().join(worse, [*group, "u"], "left_anti")
        new = settle(open_.join(heads, [*group, "u"], "left_semi").select(*node).distinct())
        taken = new if taken is None else taken.unionByName(new)
        left = open_.join(new, node, "left_anti").join(new.withColumnRenamed("v", "u"), [*group, "u"], "left_anti")
        open_ = settle(left)
    everyone = rows.where(can).select(*group, F.struct("_p", F.col("_k").alias("_i")).alias("v"))
    leads = everyone if taken is None else everyone.join(taken, node, "left_anti")
    own = leads.select(*group, F.col("v._i").alias(key), F.col("v._i").alias("lead"), F.lit(1).cast("long").alias("is_lead"))
    first = near.join(leads.withColumnRenamed("v", "u"), [*group, "u"]).groupBy(*node).agg(F.min("u").alias("u"))
    return own.unionByName(first.select(*group, F.col("v._i").alias(key), F.col("u._i").alias("lead"), F.lit(0).cast("long").alias("is_lead")))


def ld_proxies(edges: DataFrame, leads: DataFrame, group: list[str], key: str, least: float = 0.5) -> DataFrame:
    """``group, lead, proxy, r2``: rows linked to a lead with r2 of ``least`` or more, the lead among them (r2 1)."""
    ends = edges.where(F.col("r2") >= least).where("a <> b")
    both = ends.select(*group, F.col("a").alias("lead"), F.col("b").alias("proxy"), "r2").unionByName(ends.select(*group, F.col("b").alias("lead"), F.col("a").alias("proxy"), "r2"))
    heads = leads.select(*group, F.col(key).alias("lead")).distinct()
    return both.join(heads, [*group, "lead"]).unionByName(heads.select(*group, "lead", F.col("lead").alias("proxy"), F.lit(1.0).alias("r2")))


def clumped_loci(df: DataFrame, group: list[str], key: str, pos: str, p: str, reach: float, flank: float) -> DataFrame:
    """``group, start, end, n_leads``: windows of ``flank`` around the leads of :func:`greedy_clump`, merged where they touch."""
    from .intervals import merge_intervals, point_in_interval

    clumps = greedy_clump(df, group, key, pos, p, reach)
    leads = settle(df.join(clumps.where("is_lead = 1").select(*group, key), [*group, key]).select(*group, key, F.col(pos).alias("_at")))
    windows = leads.select(*group, F.greatest(F.col("_at") - flank, F.lit(0)).alias("_lo"), (F.col("_at") + flank).alias("_hi"))
    width = max(64.0 * flank, 1.0)
    merged = merge_intervals(windows, group, "_lo", "_hi", width).select(*group, "start", "end")
    return point_in_interval(leads, merged, group, "_at", "start", "end", width, "both").groupBy(*group, "start", "end").agg(F.count("*").alias("n_leads"))


def prune_related(edges: DataFrame, a: str, b: str, seed: str = "") -> DataFrame:
    """Nodes to drop so that no edge is left: repeatedly the one with most edges (ties by SHA-256).

    Components are independent, so each is one group.
    """
    import hashlib

    parts = components(edges, a, b)
    kind = edges.schema[a].dataType.simpleString()
    tagged = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").join(parts, F.col("a") == F.col("node")).select("component", "a", "b")

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for x, y in zip(pdf.a, pdf.b):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
        tie = {k: hashlib.sha256(f"{seed}:{k}".encode()).hexdigest() for k in near}
        gone = []
        while any(near.values()):
            top = min(near, key=lambda k: (-len(near[k]), tie[k]))
            gone.append(top)
            for y in near.pop(top):
                near[y].discard(top)
        return pd.DataFrame({"dropped": gone})

    return tagged.groupBy("component").applyInPandas(step, f"dropped {kind}")


def greedy_prune(df: DataFrame, edges: DataFrame, group: list[str], key: str, order: str, forced: str | None = None, most: int | None = None) -> DataFrame:
    """Kept keys: in order, forced ones first, each unless linked to one kept before, up to ``most``."""
    rows = df.select(*group, F.col(key).alias("a"), F.col(order).cast("double").alias("_o"), (F.col(forced).cast("int") if forced else F.lit(0)).alias("_f"), F.lit(None).cast(df.schema[key].dataType).alias("b"))
    links = edges.select(*group, "a", "b").unionByName(edges.select(*group, F.col("b").alias("a"), F.col("a").alias("b"))).withColumns({"_o": F.lit(None).cast("double"), "_f": F.lit(0)})

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.b.isna()].sort_values(["_f", "_o", "a"], ascending=[False, True, True], kind="stable")
        near = pdf[pdf.b.notna()].groupby("a").b.apply(set).to_dict()
        kept: list = []
        for k, f in zip(own.a, own._f):
            if most is not None and len(kept) >= most:
                break
            if f or not near.get(k, set()) & set(kept):
                kept.append(k)
        out = pd.DataFrame({key: kept})
        for g in reversed(group):
            out.insert(0, g, pdf[g].iloc[0])
        return out

    return _per_group(rows.unionByName(links), group, step, f"{_fields(df, *group, key)}")


def complete_teams(r2: np.ndarray, threshold: float) -> list[int]:
    """The first row of each row's team: closest teams merge first, by their farthest pair, while that exceeds the threshold.

    The largest entry of each row is kept, and only rows whose largest entry changed are searched again.
    """
    n = len(r2)
    sim = np.where(r2 > threshold, r2, -1.0)
    np.fill_diagonal(sim, -1.0)
    team, best = np.arange(n), sim.max(1, initial=-1.0)
    while n and best.max() > threshold:
        i = int(best.argmax())
        j = int(sim[i].argmax())
        lost = np.flatnonzero((sim[i] > 0) | (sim[j] > 0))
        team[team == j] = i
        sim[i] = sim[:, i] = np.minimum(sim[i], sim[j])
        sim[j] = sim[:, j] = -1.0
        sim[i, i] = -1.0
        for k in {i, j, *lost.tolist()}:
            best[k] = sim[k].max()
    return team.tolist()


def complete_linkage(edges: DataFrame, nodes: DataFrame, group: list[str], key: str, r2: str = "r2", threshold: float = 0.8) -> DataFrame:
    """Teams in which every pair exceeds the threshold: closest teams merge first; ``team`` is its least key.

    A group is one task; long groups go by :func:`strandset.operators.linkage.blocked_linkage`.
    """
    rows = nodes.select(*group, F.col(key).alias("a"), F.lit(None).cast(nodes.schema[key].dataType).alias("b"), F.lit(None).cast("double").alias("_r")).unionByName(edges.where(F.col(r2) > threshold).select(*group, "a", "b", F.col(r2).cast("double").alias("_r")))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf[pdf.b.isna()].a)
        at = {k: i for i, k in enumerate(ids)}
        sim = np.full((len(ids), len(ids)), -1.0)
        for x, y, r in pdf[pdf.b.notna()][["a", "b", "_r"]].itertuples(index=False):
            sim[at[x], at[y]] = sim[at[y], at[x]] = r
        out = pd.DataFrame({key: ids, "team": [ids[t] for t in complete_teams(sim, threshold)]})
        for g in reversed(group):
            out.insert(0, g, pdf[g].iloc[0])
        return out

    kind = nodes.schema[key].dataType.simpleString()
    return _per_group(rows, group, step, f"{_fields(nodes, *group)}, `{key}` {kind}, team {kind}")


def leaders(edges: DataFrame, nodes: DataFrame, group: list[str], key: str, order: str, r2: str = "r2", threshold: float = 0.8) -> DataFrame:
    """First come first served: each key joins the earliest leader it exceeds the threshold with, or leads."""
    both = edges.where(F.col(r2) > threshold).select(*group, "a", "b")
    rows = nodes.select(*group, F.col(key).alias("a"), F.col(order).cast("double").alias("_o"), F.lit(None).cast(nodes.schema[key].dataType).alias("b")).unionByName(
        both.unionByName(both.select(*group, F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("_o", F.lit(None).cast("double"))
    )

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.b.isna()].sort_values(["_o", "a"], kind="stable")
        near = pdf[pdf.b.notna()].groupby("a").b.apply(set).to_dict()
        heads: list = []
        out = []
        for k in own.a:
            found = next((h for h in heads if h in near.get(k, ())), None)
            if found is None:
                heads.append(k)
                found = k
            out.append(found)
        got = pd.DataFrame({key: list(own.a), "leader": out})
        for g in reversed(group):
            got.insert(0, g, pdf[g].iloc[0])
        return got

    kind = nodes.schema[key].dataType.simpleString()
    return _per_group(rows, group, step, f"{_fields(nodes, *group)}, `{key}` {kind}, leader {kind}")


def average_linkage(df: DataFrame, group: list[str], key: str, vector: str, k: int) -> DataFrame:
    """``cluster`` (0-based, by least key) of average-link clustering of each group to k clusters."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.array(pdf[vector].tolist(), float)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        size, team = np.ones(len(x)), np.arange(len(x))
        for _ in range(max(0, len(x) - k)):
            i, j = divmod(int(d.argmin()), len(x))
            i, j = min(i, j), max(i, j)
            row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
            d[i] = d[:, i] = row
            d[j] = d[:, j] = np.inf
            d[i, i] = np.inf
            size[i] += size[j]
            team[team == j] = i
        names = {t: n for n, t in enumerate(dict.fromkeys(team.tolist()))}
        return pdf[group + [key]].assign(cluster=[names[t] for t in team.tolist()])

    return _per_group(df.select(*group, key, vector), group, step, f"{_fields(df, *group, key)}, cluster long")


def dbscan(df: DataFrame, group: list[str], key: str, vector: str, eps: float, least: int) -> DataFrame:
    """Density clusters of each group; noise is -1."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.array(pdf[vector].tolist(), float)
        near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
        core = near.sum(1) >= least
        label, n = np.full(len(x), -1), 0
        for i in range(len(x)):
            if core[i] and label[i] < 0:
                stack = [i]
                label[i] = n
                while stack:
                    v = stack.pop()
                    if core[v]:
                        for w in np.flatnonzero(near[v] & (label < 0)):
                            label[w] = n
                            stack.append(w)
                n += 1
        return pdf[group + [key]].assign(cluster=label)

    return _per_group(df.select(*group, key, vector), group, step, f"{_fields(df, *group, key)}, cluster long")


def gaussian_mixture(df: DataFrame, vector: str, ks: list[int], seed: int = 1) -> tuple[int, DataFrame]:
    """The number of components with the least BIC, and every row's cluster under it."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    d = rows.select(F.size(vector)).first()[0]
    n = rows.count()
    fits = []
    for k in ks:
        model = GaussianMixture(k=k, featuresCol="_v", predictionCol="cluster", probabilityCol="_p", seed=seed).fit(rows)
        free = k * (d + d * (d + 1) / 2) + k - 1
        fits.append((-2 * model.summary.logLikelihood + free * float(np.log(n)), k, model))
    best = min(fits, key=lambda f: f[:2])
    return best[1], best[2].transform(rows).drop("_v", "_p")


def mixed_distance(df: DataFrame, group: list[str], key: str, tags: str, klass: str, numbers: list[str]) -> DataFrame:
    """Pairs of a group with the mean of Jaccard distance of tags, class mismatch and absolute number differences."""
    cols = [tags, klass, *numbers]
    a = df.select(*group, F.col(key).alias("a"), *[F.col(c).alias(f"_a_{c}") for c in cols])
    b = df.select(*group, F.col(key).alias("b"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    from .sets import jaccard

    parts = [1.0 - F.coalesce(jaccard(F.col(f"_a_{tags}"), F.col(f"_b_{tags}")), F.lit(1.0)), (F.col(f"_a_{klass}") != F.col(f"_b_{klass}")).cast("double")] + [F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) for c in numbers]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return a.join(b, group).where("a < b").select(*group, "a", "b", (total / len(parts)).alias("distance"))


def intrinsic_dimension(neighbours: DataFrame) -> DataFrame:
    """TwoNN estimate from the ratio of the second to the first neighbour distance (``query_id, rank, distance``)."""
    two = neighbours.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("r2"))
    used = two.where("r1 > 0 AND r2 > r1")
    return used.agg((F.count("*") / F.sum(F.log(F.col("r2") / F.col("r1")))).alias("dimension"), F.count("*").alias("n"))


def likelihood_dimension(neighbours: DataFrame, k: int) -> DataFrame:
    """``dimension, n``: maximum-likelihood estimate from the logarithms of neighbour distances over the kth's.

    ``neighbours`` has ``query_id, rank, distance``; queries with fewer than k neighbours or
    a neighbour at distance 0 are left out, as are estimates of fewer than 20 queries.
    """
    near = neighbours.where(F.col("rank") <= k)
    far = near.groupBy("query_id").agg(F.max("distance").alias("_far"), F.count("*").alias("_n"), F.min("distance").alias("_near")).where((F.col("_n") == k) & (F.col("_near") > 0))
    each = near.join(far, "query_id").groupBy("query_id").agg((F.sum(F.log(F.col("_far") / F.col("distance"))) / (k - 1)).alias("_inverse"))
    return each.agg(F.when((F.count("*") >= 20) & (F.avg("_inverse") > 0), 1.0 / F.avg("_inverse")).alias("dimension"), F.count("*").alias("n"))


def bimodality(df: DataFrame, group: list[str], value: str, least: int = 30) -> DataFrame:
    """``group, n, coefficient``: (skewness^2 + 1) over the kurtosis with its sample correction; above 5/9 hints at two modes.

    From central moments in one aggregate; NULL for fewer than ``least`` finite values or a constant.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.skewness(x).alias("_s"), F.kurtosis(x).alias("_k"), F.var_pop(x).alias("_v"))
    n = F.col("n").cast("double")
    coefficient = (F.col("_s") * F.col("_s") + 1.0) / (F.col("_k") + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))
    return out.select(*group, "n", F.when((n >= least) & (F.col("_v") > 0), coefficient).alias("coefficient"))


def hopkins(df: DataFrame, key: str, vector: str, m: int, seed: int = 1) -> float:
    """Clustering tendency: distances of uniform probes against those of ``m`` sampled rows (a sampling operator)."""
    from .sets import nearest_neighbours

    sample = df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256)).limit(m)
    dims = df.select(F.posexplode(F.col(vector).cast("array<double>"))).groupBy("pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).orderBy("pos").collect()
    rng = np.random.default_rng(seed)
    probes = [(-1 - i, [float(rng.uniform(r.lo, r.hi)) for r in dims]) for i in range(m)]
    spark = df.sparkSession
    queries = spark.createDataFrame(probes, f"{key} long, {vector} array<double>")
    rows = df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    u = nearest_neighbours(rows, key, vector, 1, queries).agg(F.sum("distance")).first()[0]
    w = nearest_neighbours(rows, key, vector, 1, sample.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))).agg(F.sum("distance")).first()[0]
    return u / (u + w)

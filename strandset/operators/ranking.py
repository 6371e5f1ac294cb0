"""Ranks, quantiles, bins, top-k, runs and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import normal_quantile, normal_quantile_exact
from .scan import quantile_bucket, running, settle


def average_rank(column: str, group: list[str]) -> Column:
    """1-based rank in a group, ties averaged."""
    peers = F.count("*").over(Window.partitionBy(*group, column))
    return F.rank().over(Window.partitionBy(*group).orderBy(column)) + (peers - 1) / 2.0


def percent_rank_in_group(column: str, group: list[str]) -> Column:
    return average_rank(column, group) / F.count("*").over(Window.partitionBy(*group))


def value_ranks(df: DataFrame, column: str, group: list[str] | None = None) -> DataFrame:
    """``column, n_below, n_at, n_all`` of each distinct value: ranks without a window over rows.

    Values are counted before any shuffle, and the running sum goes bucket by bucket, so
    neither a frequent value nor the lack of a group meets in one task.
    """
    group = group or []
    counted = settle(df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("n_at")))
    bucket = quantile_bucket(counted, column)
    out = running(counted, group, [column], bucket, {"n_below": ("sum", F.col("n_at"))}, exclusive=True)
    totals = counted.groupBy(*group).agg(F.sum("n_at").alias("n_all")) if group else counted.agg(F.sum("n_at").alias("n_all"))
    return out.join(totals, group) if group else out.crossJoin(F.broadcast(totals))


def global_average_rank(df: DataFrame, column: str, name: str = "avg_rank") -> DataFrame:
    """Average rank over the whole table."""
    ranks = value_ranks(df, column).select(F.col(column).alias("_v"), (F.col("n_below") + (F.col("n_at") + 1) / 2.0).alias(name))
    return df.join(ranks, df[column] == ranks["_v"], "left").drop("_v")


def global_min_rank(df: DataFrame, column: str, name: str = "min_rank") -> DataFrame:
    """Rank over the whole table, equal values all with the least; NULL keeps NULL."""
    ranks = value_ranks(df, column).select(F.col(column).alias("_v"), (F.col("n_below") + 1).alias(name))
    return df.join(ranks, df[column] == ranks["_v"], "left").drop("_v")


def ecdf_against(df: DataFrame, reference: DataFrame, column: str, name: str = "ecdf", missing: float = 0.5) -> DataFrame:
    """Average-rank ECDF of values in a reference population; the denominator counts its missing values."""
    n = reference.agg(F.count("*").alias("_n"))
    both = df.select(column).where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(0).cast("long").alias("n_at")).unionByName(reference.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_at")))
    per = settle(both.groupBy(column).agg(F.sum("n_at").alias("n_at")))
    placed = running(per, [], [column], quantile_bucket(per, column), {"n_below": ("sum", F.col("n_at"))}, exclusive=True)
    score = placed.crossJoin(F.broadcast(n)).select(F.col(column).alias("_v"), ((F.col("n_below") + 0.5 * F.col("n_at")) / F.col("_n")).alias(name))
    return df.join(score, df[column] == score["_v"], "left").drop("_v").withColumn(name, F.coalesce(F.col(name), F.lit(missing)))


def inverse_normal_ranks(df: DataFrame, column: str, name: str = "rint", mode: str = "winitzki", offset: float = 0.375) -> DataFrame:
    """Rank-based inverse normal (Blom offset 3/8); ``mode`` is ``winitzki`` or ``exact``."""
    ranked = global_average_rank(df, column, "_rank")
    n = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("_n"))
    p = (F.col("_rank") - offset) / (F.col("_n") + 1 - 2 * offset)
    value = normal_quantile(p) if mode == "winitzki" else normal_quantile_exact(p)
    return ranked.crossJoin(F.broadcast(n)).withColumn(name, value).drop("_rank", "_n")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group (Spark keeps only k a task before the shuffle)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def hash_order(seed: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *columns), 256)


def top_k_by_hash(df: DataFrame, group: list[str], seed: str, columns: list[str], k: int) -> DataFrame:
    return top_k(df, group, [hash_order(seed, *columns), *map(F.col, columns)], k)


def majority_label(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """The most frequent label of each group, the lowest on ties."""
    counts = df.groupBy(*group, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(label).alias("label"))).alias("b")).select(*group, F.col("b.label").alias(label), (-F.col("b.minus")).alias("n"))


def gap_runs(df: DataFrame, keys: list[str], pos: str, gap: float, name: str = "run") -> DataFrame:
    """Numbers runs of rows whose step from the row before is at most ``gap``."""
    w = Window.partitionBy(*keys).orderBy(pos)
    new = F.coalesce((F.col(pos) - F.lag(pos).over(w) > gap).cast("long"), F.lit(0))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sliding_windows(df: DataFrame, keys: list[str], order: list[str], size: int, step: int) -> DataFrame:
    """Rows with each full window of ``size`` rows that they belong to, windows starting every ``step``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*keys))
    rn = (F.row_number().over(w) - 1).alias("_rn")
    numbered = df.select("*", rn, n.alias("_n"))
    first = F.greatest(F.ceil((F.col("_rn") - size + 1) / float(step)), F.lit(0))
    last = F.least(F.floor(F.col("_rn") / float(step)), F.floor((F.col("_n") - size) / float(step)))
    ids = F.when(F.col("_n") >= size, F.when(first <= last, F.sequence(first, last)))
    return numbered.withColumn("window_id", F.explode(ids)).drop("_rn", "_n")


def tile(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)) * size


def linear_quantiles(df: DataFrame, column: str, probabilities: list[float], group: list[str] | None = None) -> DataFrame:
    """Exact quantiles ``q`` with linear interpolation, from the ranks of counted values."""
    group = group or []
    ranked = value_ranks(df, column, group)
    found = []
    for p in probabilities:
        at = (F.col("n_all") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        value = lambda k: F.max(F.when((F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n_at")), F.col(column)))
        found.append(value(low) + (value(high) - value(low)) * (F.max(at) - F.floor(F.max(at))))
    return (ranked.groupBy(*group) if group else ranked).agg(F.array(*found).alias("q"))


def order_statistic(column: str, share: float) -> Column:
    """``sorted[int(share * n)]`` of a group's values: an order statistic, not interpolated.

    For groups that fit a task; the whole table has :func:`value_ranks`.
    """
    values = F.array_sort(F.collect_list(column))
    return F.element_at(values, (F.floor(F.count(column) * F.lit(share)) + 1).cast("int"))


def quantile_labels(df: DataFrame, column: str, parts: int, name: str = "part") -> DataFrame:
    """0-based part by interior quantiles (linear); a value on a cut belongs to the part above it."""
    cuts = linear_quantiles(df, column, [k / parts for k in range(1, parts)]).withColumnRenamed("q", "_cuts")
    label = F.size(F.filter("_cuts", lambda c: c <= F.col(column)))
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, F.when(F.col(column).isNotNull(), label)).drop("_cuts")


def group_quantile_split(df: DataFrame, column: str, group: list[str], parts: int, name: str = "part") -> DataFrame:
    cuts = linear_quantiles(df, column, [k / parts for k in range(1, parts)], group).withColumnRenamed("q", "_cuts")
    label = F.size(F.filter("_cuts", lambda c: c <= F.col(column)))
    return df.join(cuts, group).withColumn(name, F.when(F.col(column).isNotNull(), label)).drop("_cuts")


def quota_top(df: DataFrame, quotas: DataFrame, group: list[str], order: list[Column], quota: str = "quota") -> tuple[DataFrame, DataFrame]:
    """As many first rows of each group as its quota, and the groups that fall short."""
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    chosen = numbered.join(quotas, group).where(F.col("_rn") <= F.col(quota)).drop("_rn")
    have = df.groupBy(*group).agg(F.count("*").alias("available"))
    short = quotas.join(have, group, "left").fillna({"available": 0}).where(F.col("available") < F.col(quota)).withColumn("shortage", F.col(quota) - F.col("available"))
    return chosen, short


def bh_adjusted(df: DataFrame, p: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q of every row, over the whole table; NULL p stays NULL."""
    df = settle(df)
    per = settle(value_ranks(df, p).withColumn("_raw", F.col(p) * F.col("n_all") / (F.col("n_below") + F.col("n_at"))))
    q = running(per, [], [p], quantile_bucket(per, p), {"_q": ("min", F.col("_raw"))}, backward=True).select(F.col(p).alias("_p"), F.least(F.col("_q"), F.lit(1.0)).alias(name))
    return df.join(q, df[p] == q["_p"], "left").drop("_p")


def bh_rejections(df: DataFrame, p: str, alpha: float, mode: str = "stepup") -> DataFrame:
    """How many are rejected: ``stepup`` (all up to the last below its line) or ``pointwise`` (each below its own line)."""
    per = value_ranks(df, p).withColumn("rank", F.col("n_below") + F.col("n_at"))
    below = F.col(p) <= F.lit(alpha) * F.col("rank") / F.col("n_all")
    if mode == "stepup":
        return per.agg(F.coalesce(F.max(F.when(below, F.col("rank"))), F.lit(0)).alias("n_rejected"))
    # ties take successive ranks; of equal p those at or past the first sufficient rank are below their line
    first = F.ceil(F.col(p) * F.col("n_all") / F.lit(alpha) - 1e-9)
    count = F.greatest(F.col("rank") - F.greatest(first, F.col("n_below") + 1) + 1, F.lit(0))
    return per.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n_rejected"))


def calibration(df: DataFrame, score: str, truth: str, parts: int = 10) -> DataFrame:
    """Mean score and mean truth of each score part."""
    return quantile_labels(df, score, parts, "part").groupBy("part").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("mean_truth"))

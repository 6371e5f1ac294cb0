"""Permutations, bootstraps, splits and matched samples in hash order.

Every draw is an ordering by SHA-256 of (seed, replicate, id), so it does not depend on
partitioning, can be repeated after a lost executor, and any engine with SHA-256 agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import settle


def draw(seed: str, *columns: str) -> Column:
    """A hex digest to order by."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)


def uniform(seed: str, *columns: str) -> Column:
    """A number in [0, 1) from 48 bits of the digest."""
    return F.conv(F.substring(draw(seed, *columns), 1, 12), 16, 10).cast("double") / float(16**12)


def replicated(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def permute_within(df: DataFrame, group: list[str], key: str, value: str, reps: int, seed: str) -> DataFrame:
    """``value`` dealt anew among the rows of each group, for each replicate (column ``permuted``).

    Rows are numbered once by key and, over all replicates, by digest; as both orders have
    the groups in the same places of each replicate, equal places are rows of one group.
    Numbers come from ranges, so neither a replicate nor a group is one task's.
    """
    rows = df.select(*group, key, value)
    by_key = _numbered(rows.withColumn("_o", F.struct(*group, key)), "_o").drop("_o")
    n = by_key.count()
    order = F.struct("rep", *group, F.unhex(draw(seed, "rep", key)).alias("_d"), key)
    by_draw = _numbered(replicated(rows, reps).select("rep", F.col(value).alias("permuted"), order.alias("_o")), "_o").select("rep", "permuted", (F.col("_i") - F.col("rep") * F.lit(n)).alias("_i"))
    return _beside(by_key, by_draw).select("rep", *group, key, value, "permuted")


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on ``_i`` by sorting: a settled table is still taken for as small as the files it was made from, and would be broadcast."""
    return left.hint("merge").join(right, "_i")


def column_shuffle(df: DataFrame, key: str, blocks: list[list[str]], seed: str) -> DataFrame:
    """Each block of columns permuted over the rows together, blocks independently."""
    out = _numbered(df.select(key), key)
    for k, block in enumerate(blocks):
        part = _numbered(df.select(*block, draw(f"{seed}{k}", key).alias("_d")), "_d").drop("_d")
        out = _beside(out, part)
    return out.drop("_i")


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds ``_i``: the place of each row in the order of a column without repeats, by ranges of it.

    Only the row counts of the ranges meet in one task.
    """
    parts = settle(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_part").agg(F.count("*").alias("_c")).select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("_i", inside).join(F.broadcast(base), "_part").withColumn("_i", F.col("_i") + F.col("_base")).drop("_part", "_base")


def circular_shift(df: DataFrame, group: list[str], order: list[str], value: str, shift: int) -> DataFrame:
    """Each row with the value ``shift`` places on in its group, around the end."""
    w = Window.partitionBy(*group)
    numbered = df.select("*", (F.row_number().over(w.orderBy(*order)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    source = numbered.select(*group, F.pmod(F.col("_i") - shift, F.col("_n")).alias("_i"), F.col(value).alias("shifted"))
    return numbered.drop("_n").join(source, [*group, "_i"]).drop("_i")


def matched_sample(pool: DataFrame, want: DataFrame, strata: list[str], key: str, reps: int, seed: str) -> DataFrame:
    """As many pool rows of each stratum, without replacement, as ``want`` asks for (column ``k``)."""
    rows = replicated(pool.select(*strata, key).join(want, strata), reps)
    order = Window.partitionBy("rep", *strata).orderBy(draw(seed, "rep", key), key)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r <= k").drop("_r", "k")


def bootstrap_means(df: DataFrame, key: str, value: str, reps: int, seed: str) -> DataFrame:
    """Means of resampled tables: each row counts Poisson(1) times, drawn from its digest.

    Poisson weights need no index join and no shuffle of rows: one aggregate a replicate.
    """
    u = uniform(seed, "rep", key)
    count: Column = F.lit(0)
    p, total = 2.718281828459045**-1, 0.0
    for k in range(12):
        total += p
        count = count + (u >= total).cast("int")
        p /= k + 1
    return replicated(df.select(key, value), reps).withColumn("_w", count).groupBy("rep").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("mean"))


def percentile_interval(reps: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    lo = (1 - level) / 2
    return reps.agg(F.expr(f"percentile({value}, {lo})").alias("low"), F.expr(f"percentile({value}, {1 - lo})").alias("high"))


def random_sign(seed: str, *columns: str) -> Column:
    """+1 or -1 by the first bit of the digest (wild bootstrap)."""
    return F.when(F.substring(draw(seed, *columns), 1, 1).isin(list("01234567")), 1).otherwise(-1)


def empirical_p(null: DataFrame, observed: Column, value: str = "stat") -> DataFrame:
    """(1 + replicates at or above the observed) / (replicates + 1), and the null's moments."""
    out = null.agg(F.count("*").alias("n_reps"), F.count_if(F.col(value) >= observed).alias("n_ge"), F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd"), F.expr(f"percentile({value}, 0.95)").alias("null_q95"))
    return out.withColumns({"p": (F.col("n_ge") + 1) / (F.col("n_reps") + 1), "z": F.when(F.col("null_sd") > 0, (observed - F.col("null_mean")) / F.col("null_sd"))})


def quotas(sizes: DataFrame, n: str, total: int, order: list[str]) -> DataFrame:
    """Proportional allocation by largest remainder (column ``quota``); one row a stratum."""
    all_n = sizes.agg(F.sum(n).alias("_all"))
    exact = F.lit(float(total)) * F.col(n) / F.col("_all")
    base = sizes.crossJoin(F.broadcast(all_n)).withColumns({"_base": F.floor(exact), "_rest": exact - F.floor(exact)})
    left = F.lit(total) - F.sum("_base").over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("_rest", 9)), *order))
    return base.withColumn("quota", F.col("_base") + (rank <= left).cast("long")).drop("_all", "_base", "_rest")


def stratified_sample(df: DataFrame, strata: list[str], key: str, total: int, seed: str) -> DataFrame:
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    want = quotas(sizes, "_n", total, strata).select(*strata, "quota")
    order = Window.partitionBy(*strata).orderBy(draw(seed, key), key)
    return df.withColumn("_r", F.row_number().over(order)).join(want, strata).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def capped(df: DataFrame, group: list[str], key: str, cap: int, seed: str) -> DataFrame:
    """At most ``cap`` rows of each group, in hash order (a sampling operator)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(draw(seed, key), key))).where(F.col("_r") <= cap).drop("_r")


def split_by_hash(key: str, seed: str, shares: list[tuple[str, float]]) -> Column:
    """Label by hash with the given shares; stable under reordering and new rows."""
    u, out, edge = uniform(seed, key), F.lit(shares[-1][0]), sum(s for _, s in shares[:-1])
    for name, share in reversed(shares[:-1]):
        out = F.when(u < edge, name).otherwise(out)
        edge -= share
    return out


def fold_of(key: str, seed: str, k: int) -> Column:
    return F.floor(uniform(seed, key) * k).cast("int")


def balanced_folds(df: DataFrame, group: list[str], key: str, k: int, seed: str) -> DataFrame:
    """Folds of sizes that differ by at most one within each group."""
    order = Window.partitionBy(*group).orderBy(draw(seed, key), key)
    return df.withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(k)))


def thinned(df: DataFrame, group: list[str], order: list[str], cap: int) -> DataFrame:
    """Evenly spaced rows down to ``cap`` a group (systematic thinning)."""
    w = Window.partitionBy(*group)
    rows = df.select("*", (F.row_number().over(w.orderBy(*order)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    step = (F.col("_n") - 1) / F.lit(float(max(cap - 1, 1)))
    nearest = F.round(F.col("_i") / step)  # the one number whose place can be this row; its neighbours for halves
    hit = lambda j: (j >= 0) & (j < cap) & (F.round(j * step).cast("long") == F.col("_i"))
    keep = (F.col("_n") <= cap) | hit(nearest) | hit(nearest - 1) | hit(nearest + 1)
    return rows.where(keep).drop("_i", "_n")


def block_placement(blocks: DataFrame, key: str, length: str, order: str, extent: float, reps: int, seed: str) -> DataFrame:
    """Blocks of kept lengths and order at random places: gaps are exponential draws scaled to the free space."""
    rows = replicated(blocks.select(key, length, order), reps).withColumn("_g", -F.log(1.0 - uniform(seed, "rep", key)))
    w = Window.partitionBy("rep")
    before = w.orderBy(order, key).rowsBetween(Window.unboundedPreceding, -1)
    last = -F.log(1.0 - F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.lit("end")), 256), 1, 12), 16, 10).cast("double") / float(16**12))
    free = F.lit(float(extent)) - F.sum(length).over(w)
    gap = (F.coalesce(F.sum("_g").over(before), F.lit(0.0)) + F.col("_g")) / (F.sum("_g").over(w) + last)
    start = gap * free + F.coalesce(F.sum(length).over(before), F.lit(0))
    return rows.select("rep", key, start.alias("start"), (start + F.col(length)).alias("end"))


def nearest_controls(wanted: DataFrame, pool: DataFrame, keys: list[str], value: str, control: str, width: float, seed: str, name: str = "control") -> DataFrame:
    """Each wanted row with the pool row of nearest ``value`` (the lower on equal distance; of equal values the first by hash)."""
    from .intervals import nearest

    near = nearest(wanted, pool, keys, value, value, width)
    named = pool.groupBy(*keys, F.col(value).cast("double").alias("nearest_at")).agg(F.min(F.struct(draw(seed, control).alias("d"), F.col(control).alias("c")))["c"].alias(name))
    return near.join(named, [*keys, "nearest_at"], "left").select(*wanted.columns, name, "distance")

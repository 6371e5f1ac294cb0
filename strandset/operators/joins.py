"""Keyed joins with stated duplicate and cardinality policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import complement
from .scan import settle, task_count


def one_per_key(df: DataFrame, keys: list[str], policy: str = "error", order: list[str] | None = None) -> DataFrame:
    """At most one row a key: ``first``/``last`` by ``order``, ``min``/``max`` alike, or ``error``."""
    others = [c for c in df.columns if c not in keys]
    if policy == "error":
        return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key is not unique"))).otherwise(F.col("_n"))).where("_n = 1").drop("_n")
    if not order:
        raise ValueError("an order decides which row stays")
    pick = F.min if policy in ("first", "min") else F.max
    # an aggregate is combined before the shuffle, a row_number window is not
    row = pick(F.struct(*order, *[c for c in others if c not in order])).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def lookup(left: DataFrame, right: DataFrame, keys: list[str], fill: dict | None = None, policy: str = "error", order: list[str] | None = None) -> DataFrame:
    """Left join against a table made unique by the policy; missing values filled."""
    out = left.join(one_per_key(right, keys, policy, order), keys, "left")
    return out.fillna(fill) if fill else out


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def validated(left: DataFrame, right: DataFrame, keys: list[str], validate: str = "m:1", how: str = "inner") -> DataFrame:
    """A join that fails where the promised side is not unique (``1:1``, ``m:1``, ``1:m``)."""
    a, b = validate.split(":")
    left = one_per_key(left, keys) if a == "1" else left
    right = one_per_key(right, keys) if b == "1" else right
    return left.join(right, keys, how)


def multi_orientation(variants: DataFrame, panel: DataFrame, place: list[str], ref: str, alt: str) -> DataFrame:
    """Variants matched to a panel in up to four orientations; ``sign`` and ``label`` of the first that fits."""
    kinds = [("direct", 1, F.col(ref), F.col(alt)), ("swap", -1, F.col(alt), F.col(ref)), ("rc", 1, complement(F.col(ref)), complement(F.col(alt))), ("swap_rc", -1, complement(F.col(alt)), complement(F.col(ref)))]
    tries = F.array(*[F.struct(F.lit(i).alias("try"), F.lit(s).alias("sign"), F.lit(n).alias("label"), a.alias("_r"), b.alias("_a")) for i, (n, s, a, b) in enumerate(kinds)])
    ids = variants.columns
    spread = variants.withColumn("_t", F.explode(tries)).select(*ids, "_t.*")
    right = panel.withColumnsRenamed({ref: "_r", alt: "_a"}).withColumn("matched_key", F.concat_ws(":", *place, "_r", "_a"))
    hit = spread.join(right, [*place, "_r", "_a"])
    best = hit.groupBy(*ids).agg(F.min(F.struct("try", "sign", "label", "matched_key")).alias("_b"))
    return best.select(*ids, "_b.sign", "_b.label", "_b.matched_key")


def unordered(left: DataFrame, right: DataFrame, place: list[str], pair: tuple[str, str], how: str = "inner") -> DataFrame:
    """Join on places and an allele pair whatever its order."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_lo": F.least(*pair), "_hi": F.greatest(*pair)})

    return keyed(left).join(keyed(right).drop(*pair), [*place, "_lo", "_hi"], how).drop("_lo", "_hi")


def position_check(left: DataFrame, right: DataFrame, place: list[str], alleles: tuple[str, str]) -> DataFrame:
    """Join on position only; ``allele_status`` tells same, swapped or mismatch."""
    a, b = alleles
    joined = left.join(right.withColumnsRenamed({a: f"other_{a}", b: f"other_{b}"}), place)
    same, swap = (F.col(a) == F.col(f"other_{a}")) & (F.col(b) == F.col(f"other_{b}")), (F.col(a) == F.col(f"other_{b}")) & (F.col(b) == F.col(f"other_{a}"))
    return joined.withColumn("allele_status", F.when(same, "same").when(swap, "swapped").otherwise("mismatch"))


def position_counts(left: DataFrame, right: DataFrame, place: list[str], alleles: tuple[str, str]) -> DataFrame:
    """``allele_status, n``: the pairs of :func:`position_check` counted, without making them.

    Rows that agree in place and alleles are counted on each side first; what meets are these
    kinds, and a meeting stands for the product of their counts.
    """
    kinds = [side.groupBy(*place, *alleles).agg(F.count("*").alias(name)) for side, name in ((left, "_n"), (right, "_m"))]
    return position_check(*kinds, place, alleles).groupBy("allele_status").agg(F.sum(F.col("_n") * F.col("_m")).alias("n"))


def dealt_sides(rows: DataFrame, group: list[str], item: str, part_rows: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``rows`` for both sides of a join on ``group`` and ``_deal``: a group of many rows is dealt by
    ``item`` to parts of about ``part_rows`` on the left, and copied to each of them on the right."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(float(part_rows))).cast("int").alias("_deals"))
    sized = rows.join(sizes, group)
    left = sized.withColumn("_deal", F.pmod(F.xxhash64(item), F.col("_deals")).cast("int"))
    return left.drop("_deals"), sized.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals")


def pairs_within(df: DataFrame, group: list[str], item: str, inside: list[str] | None = None) -> DataFrame:
    """Distinct items of a group that occur together, as ``a < b`` with their common groups counted.

    The sets of a group are pre-aggregated; groups are the join key, so no group is
    crossed with another, and a large one is dealt to many tasks.  Pairs are kept apart by
    the columns ``inside``.  The number of tasks follows the number of pairs to make, so a
    task's memory does not grow with the table.
    """
    inside = inside or []
    key = [*group, *inside]
    rows = df.select(*key, item)
    rows = settle(rows.repartition(task_count(df.sparkSession, rows.count()), *key).distinct())
    pairs = rows.groupBy(*key).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0]
    tasks = task_count(df.sparkSession, pairs or 0)
    left, right = dealt_sides(rows, key, item)
    left, right = (side.repartition(tasks, *key, "_deal") for side in (left, right))
    both = left.withColumnRenamed(item, "a").join(right.withColumnRenamed(item, "b"), [*key, "_deal"]).where("a < b")
    return both.select(*inside, "a", "b").repartition(tasks, *inside, "a", "b").groupBy(*inside, "a", "b").agg(F.count("*").alias("n_common"))


def best_match(df: DataFrame, group: str, item: str) -> DataFrame:
    """For each group the other with the largest Jaccard similarity of items (ties: least other)."""
    one = df.select(group, item).distinct()
    sizes = one.groupBy(group).agg(F.count("*").alias("n"))
    common = pairs_within(one, [item], group)
    both = common.select(F.col("a").alias(group), F.col("b").alias("other"), "n_common").unionByName(common.select(F.col("b").alias(group), F.col("a").alias("other"), "n_common"))
    scored = both.join(sizes, group).join(sizes.select(F.col(group).alias("other"), F.col("n").alias("n_other")), "other")
    jaccard = F.col("n_common") / (F.col("n") + F.col("n_other") - F.col("n_common"))
    best = scored.groupBy(group).agg(F.max(F.struct(jaccard.alias("j"), (-F.col("other")).alias("minus"))).alias("b"))
    return best.select(group, (-F.col("b.minus")).alias("other"), F.col("b.j").alias("jaccard"))


def in_all_arms(df: DataFrame, key: str, arm: str, n_arms: int) -> DataFrame:
    """Keys that every arm holds (also relational division: groups with every required value)."""
    return df.groupBy(key).agg(F.count_distinct(arm).alias("n_arms")).where(F.col("n_arms") == n_arms).select(key)


def arm_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys entered, left and kept."""
    status = before.select(*keys).distinct().withColumn("_b", F.lit(1)).join(after.select(*keys).distinct().withColumn("_a", F.lit(1)), keys, "full")
    return status.agg(F.count_if(F.col("_b").isNull()).alias("entered"), F.count_if(F.col("_a").isNull()).alias("left"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("kept"))


def same_order(left: DataFrame, right: DataFrame, order: str, key: str) -> DataFrame:
    """``rank`` and both keys where two numbered lists disagree: empty if they are aligned."""
    a, b = left.select(F.col(order).alias("rank"), F.col(key).alias("left_key")), right.select(F.col(order).alias("rank"), F.col(key).alias("right_key"))
    return a.join(b, "rank", "full").where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two key sets with ``side`` both, left or right."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, keys, "full").select(*keys, side.alias("side"))


def link_reasons(tagged: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys with the combination of reasons (``a+b``) that link them."""
    rows = reduce(DataFrame.unionByName, [df.select(*keys).withColumn("tag", F.lit(t)) for t, df in tagged.items()])
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("tag")), "+").alias("reasons"))


def with_grid(df: DataFrame, **levels: list) -> DataFrame:
    """Every row once for each combination of a few stated parameter values."""
    for name, values in levels.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def distinct_sets(df: DataFrame, group: list[str], item: str, least: int = 1) -> DataFrame:
    """Sorted distinct items of each group with at least ``least`` of them."""
    members: Column = F.array_sort(F.collect_set(item))
    return df.groupBy(*group).agg(members.alias("members")).where(F.size("members") >= least)

"""Phased haplotype windows, state dictionaries and pair support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "OTHER"


def encode(alleles: Column) -> Column:
    """Alleles 0/1 and missing (negative) to a string of ``0``, ``1`` and ``.``."""
    return F.array_join(F.transform(alleles, lambda a: F.when(a < 0, ".").otherwise(a.cast("string"))), "")


def window_states(rows: DataFrame, person: str, copy: str, window: str, order: list[str], allele: str) -> DataFrame:
    """``person, copy, window, state``: each haplotype's alleles of a window as a string."""
    cells = F.array_sort(F.collect_list(F.struct(*order, F.when(F.col(allele) < 0, ".").otherwise(F.col(allele).cast("string")).alias("_c"))))
    return rows.groupBy(person, copy, window).agg(F.array_join(F.transform(cells, lambda s: s["_c"]), "").alias("state"))


def state_dictionary(states: DataFrame, window: str, person: str, state: str = "state", least_people: int = 50, most: int = 32) -> DataFrame:
    """States that enough people carry, the most frequent first (ties by SHA-256), with their number."""
    support = states.where(~F.col(state).contains(".")).groupBy(window, state).agg(F.count_distinct(person).alias("n_people")).where(F.col("n_people") >= least_people)
    order = Window.partitionBy(window).orderBy(F.desc("n_people"), F.sha2(F.col(state), 256))
    return support.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def state_counts(states: DataFrame, dictionary: DataFrame, person: str, window: str, state: str = "state") -> DataFrame:
    """How often each person carries each dictionary state; the rest is OTHER (a person's counts sum to their copies)."""
    right = dictionary.select(F.col(window).alias("_w"), F.col(state).alias("_s"))
    known = states.join(right, (F.col(window) == F.col("_w")) & (F.col(state) == F.col("_s")), "left").select(person, window, F.coalesce("_s", F.lit(OTHER)).alias(state))
    return known.groupBy(person, window, state).agg(F.count("*").alias("n"))


def without_reference(counts: DataFrame, dictionary: DataFrame, window: str, state: str = "state") -> DataFrame:
    """Counts without each window's most frequent state, which the others determine."""
    first = dictionary.where("rank = 1").select(F.col(window).alias("_w"), F.col(state).alias("_s"))
    return counts.join(first, (F.col(window) == F.col("_w")) & (F.col(state) == F.col("_s")), "left_anti")


def two_level(counts: DataFrame, dictionary: DataFrame, window: str, state: str = "state") -> DataFrame:
    """States collapsed to the major one and the rest."""
    first = dictionary.where("rank = 1").select(window, F.col(state).alias("_s"))
    return counts.join(first, window, "left").withColumn("level", F.when(F.col(state) == F.col("_s"), "major").otherwise("rest")).drop("_s")


def pair_support(pairs: DataFrame, group: list[str], cells: tuple[str, str, str, str], least: int = 1) -> DataFrame:
    """Double heterozygotes, cis and trans of marker pairs (cells: h1j, h2j, h1k, h2k; negative is missing)."""
    a, b, c, d = (F.col(x) for x in cells)
    known = (a >= 0) & (b >= 0) & (c >= 0) & (d >= 0)
    q = (a - b) * (c - d)
    out = pairs.groupBy(*group).agg(F.count_if(known).alias("n_known"), F.count_if(known & (a != b) & (c != d)).alias("n_double_het"), F.count_if(known & (q > 0)).alias("n_cis"), F.count_if(known & (q < 0)).alias("n_trans"))
    return out.withColumn("supported", ((F.col("n_cis") >= least) & (F.col("n_trans") >= least)).cast("int"))


def select_pairs(pairs: DataFrame, tile: list[str], key: list[str], most: int, seed: str) -> DataFrame:
    """At most ``most`` pairs of a tile in hash order."""
    order = Window.partitionBy(*tile).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), *key), 256), *key)
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def member_summary(members: DataFrame, team: str, value: str) -> DataFrame:
    """Mean and maximum over a team's members with a value, and how many have one."""
    return members.groupBy(team).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(value).alias("n"))


def units(targets: DataFrame, markers: DataFrame, keys: list[str], pos: str, reach: float, seed: str) -> DataFrame:
    """Each target with all markers of its window and as many random ones of the same key (TARGET, WINDOW, NEIGHRND)."""
    from .intervals import point_in_interval

    spans = targets.select(*keys, F.col(pos).alias("target"), (F.col(pos) - reach).alias("_lo"), (F.col(pos) + reach).alias("_hi"))
    near = point_in_interval(markers.select(*keys, pos), spans, keys, pos, "_lo", "_hi", 2 * reach, "both").where(F.col(pos) != F.col("target")).select(*keys, "target", F.col(pos).alias("member"), F.lit("WINDOW").alias("kind"))
    own = targets.select(*keys, F.col(pos).alias("target"), F.col(pos).alias("member"), F.lit("TARGET").alias("kind"))
    sizes = near.groupBy(*keys, "target").agg(F.count("*").alias("_n"))
    # a target's random members: marker ranks drawn by hash from its key's list
    w = Window.partitionBy(*keys)
    ranked = markers.select(*keys, F.col(pos).alias("member"), (F.row_number().over(w.orderBy(pos)) - 1).alias("_i"), F.count("*").over(w).alias("_all"))
    totals = ranked.select(*keys, "_all").distinct()
    drawn = sizes.join(totals, keys).withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    index = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), *keys, "target", "_j"), 256), 1, 12), 16, 10).cast("long"), F.col("_all"))
    random = drawn.withColumn("_i", index).join(ranked.drop("_all"), [*keys, "_i"]).select(*keys, "target", "member", F.lit("NEIGHRND").alias("kind"))
    return own.unionByName(near).unionByName(random.distinct())

"""Group aggregates: ladders, entropies, precedence, consistency, histograms."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def census(df: DataFrame, group: list[str], value: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n")] + ([F.avg(value).alias("mean")] if value else [])
    return df.groupBy(*group).agg(*aggs)


def ratio_of_sums(df: DataFrame, group: list[str], numerator: str, denominator: str, name: str = "ratio") -> DataFrame:
    """Sum over sum, never the mean of ratios."""
    return df.groupBy(*group).agg((F.sum(numerator) / F.sum(denominator)).alias(name)) if group else df.agg((F.sum(numerator) / F.sum(denominator)).alias(name))


def floor_ladder(df: DataFrame, floors: list[float], r2: str, maf: str, group: list[str] | None = None) -> DataFrame:
    """At each floor: kept rows, summed frequency and information, their ratio (FMI), and the least M it asks for."""
    group = group or []
    spread = df.withColumn("floor", F.explode(F.array(*[F.lit(float(f)) for f in floors])))
    kept = F.col(r2) >= F.col("floor")
    out = spread.groupBy(*group, "floor").agg(F.count_if(kept).alias("n_kept"), F.sum(F.when(kept, F.col(maf)).otherwise(0.0)).alias("sum_maf"), F.sum(F.when(kept, F.col(r2) * F.col(maf)).otherwise(0.0)).alias("sum_info"))
    fmi = F.when(F.col("sum_maf") > 0, 1.0 - F.col("sum_info") / F.col("sum_maf"))
    return out.withColumn("fmi", fmi).withColumn("m", F.greatest(F.lit(10), F.ceil(100.0 * F.col("fmi") - 1e-12)))


def shares(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Counts of each value with its share of the group."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def modal_share(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return shares(df, group, value).groupBy(*group).agg(F.max("share").alias("modal_share"), F.count("*").alias("n_values"))


def histogram(c: Column, edges: list[float]) -> Column:
    """0-based bin, the last bin closed on the right; outside is NULL."""
    n = len(edges) - 1
    out = F.when((c < edges[0]) | (c > edges[-1]), None).when(c == edges[-1], n - 1)
    for k in range(n):
        out = out.when(c < edges[k + 1], k)
    return out


def capped_counts(df: DataFrame, value: str, cap: int) -> DataFrame:
    return df.groupBy(F.least(F.col(value), F.lit(cap)).alias("k")).agg(F.count("*").alias("n"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information in bits, both entropies, and the normalised form (by their geometric mean)."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pa = cells.groupBy(a).agg(F.sum("n").alias("na"))
    pb = cells.groupBy(b).agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("nt"))
    joined = cells.join(pa, a).join(pb, b).crossJoin(F.broadcast(total))
    p, q, r = F.col("n") / F.col("nt"), F.col("na") / F.col("nt"), F.col("nb") / F.col("nt")
    mi = joined.agg(F.sum(p * F.log2(p / (q * r))).alias("mi_bits"))

    def entropy(t: DataFrame, c: str, name: str) -> DataFrame:
        s = F.col(c) / F.col("nt")
        return t.crossJoin(F.broadcast(total)).agg((-F.sum(s * F.log2(s))).alias(name))

    out = mi.crossJoin(entropy(pa, "na", "h_a")).crossJoin(entropy(pb, "nb", "h_b"))
    return out.withColumn("nmi", F.when((F.col("h_a") > 0) & (F.col("h_b") > 0), F.col("mi_bits") / F.sqrt(F.col("h_a") * F.col("h_b"))))


def entropy_summary(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Entropy (bits), effective count (sum squared over sum of squares), share of singletons."""
    group = group or []
    counts = df.groupBy(*group, value).agg(F.count("*").alias("c"))
    # log2(n) - sum(c log2 c) / n needs no second pass for the total
    out = (counts.groupBy(*group) if group else counts).agg(
        F.sum("c").alias("n"), F.count("*").alias("n_values"), F.sum(F.col("c") * F.log2("c")).alias("_clogc"), F.sum(F.col("c").cast("double") * F.col("c")).alias("_sq"), F.count_if(F.col("c") == 1).alias("_one")
    )
    n = F.col("n").cast("double")
    return out.select(*group, "n", "n_values", (F.log2(n) - F.col("_clogc") / n).alias("entropy_bits"), (n * n / F.col("_sq")).alias("effective"), (F.col("_one") / F.col("n_values")).alias("singleton_share"))


def variance_ratio(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Within-group over total sum of squares of each column, from additive moments."""
    long = df.select(group, F.explode(F.create_map(*[x for v in values for x in (F.lit(v), F.col(v).cast("double"))])).alias("column", "x"))
    per = long.groupBy("column", group).agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    out = per.groupBy("column").agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("total"))
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.col("within") / F.col("total")))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def block_balanced_weights(df: DataFrame, block: list[str], klass: list[str], name: str = "weight") -> DataFrame:
    """1 / block size, then scaled so that each class has the same mass in all."""
    sizes = df.groupBy(*block, *[c for c in klass if c not in block]).agg(F.count("*").alias("_n"))
    masses = sizes.groupBy(*klass).agg(F.sum(F.lit(1.0)).alias("_mass"))
    out = df.join(sizes, list(dict.fromkeys([*block, *klass]))).join(masses, klass)
    return out.withColumn(name, 1.0 / (F.col("_n") * F.col("_mass"))).drop("_n", "_mass")


def first_available(df: DataFrame, key: list[str], value: str, source: str, priority: list[str]) -> DataFrame:
    """The value of the first source in priority order that has one."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(source))
    known = df.where(F.col(value).isNotNull() & (rank > 0))
    return known.groupBy(*key).agg(F.min(F.struct(rank.alias("r"), F.col(value).alias("v"), F.col(source).alias("s"))).alias("b")).select(*key, F.col("b.v").alias(value), F.col("b.s").alias(source))


def precedence(df: DataFrame, key: list[str], case: Column, control: Column, name: str = "status") -> DataFrame:
    """2 if any row is a case, 1 if none is but one is a control, else NULL."""
    level = F.when(case, 2).when(control, 1)
    return df.groupBy(*key).agg(F.max(level).alias(name))


def case_control_summary(df: DataFrame, status: str = "status") -> DataFrame:
    out = df.agg(F.count_if(F.col(status) == 2).alias("n_case"), F.count_if(F.col(status) == 1).alias("n_control"))
    both = F.col("n_case") + F.col("n_control")
    return out.withColumns({"prevalence": F.when(both > 0, F.col("n_case") / both), "n_eff": F.when(both > 0, 4.0 * F.col("n_case") * F.col("n_control") / both)})


def allele_counts(cells: DataFrame, variant: list[str], gt: Column, gp: Column, ds: Column) -> DataFrame:
    """AC, AN, AF under three dosage definitions: called genotypes, confident probabilities, dosages."""
    out = cells.select(*variant, gt.alias("gt"), gp.alias("gp"), ds.alias("ds")).groupBy(*variant).agg(*[x for c in ("gt", "gp", "ds") for x in (F.sum(c).cast("double").alias(f"ac_{c}"), (2 * F.count(c)).alias(f"an_{c}"))])
    return out.withColumns({f"af_{c}": F.when(F.col(f"an_{c}") > 0, F.col(f"ac_{c}") / F.col(f"an_{c}")) for c in ("gt", "gp", "ds")})


def hit_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-missing values of each column, one row a column."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("hit_rate")) for c in columns])).alias("r")).select("r.*")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL (not an error) where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def correlations(df: DataFrame, columns: list[str], least: int = 200) -> DataFrame:
    """Pearson correlation of each pair of columns over complete rows, NULL below ``least`` of them or for a constant; one pass."""
    pairs = list(combinations(columns, 2))
    aggs = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.count_if(both).alias(f"n|{a}|{b}"), correlation(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"r|{a}|{b}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`n|{a}|{b}`").alias("n"), F.when(F.col(f"`n|{a}|{b}`") >= least, F.col(f"`r|{a}|{b}`")).alias("r")) for a, b in pairs]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def leave_block_out(df: DataFrame, block: str, value: str) -> DataFrame:
    """Mean and variance without each block, by taking its moments from the total."""
    per = df.groupBy(block).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    total = per.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    n, s, q = F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tq") - F.col("q")
    return per.crossJoin(F.broadcast(total)).select(block, n.alias("n_out"), F.when(n > 0, s / n).alias("mean_out"), F.when(n > 0, q / n - (s / n) * (s / n)).alias("var_out"))


def group_then_global(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean over inner groups of their means."""
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("m")).groupBy(*outer).agg(F.avg("m").alias("mean_of_means"), F.count("*").alias("n_inner"))


def source_consistency(df: DataFrame, key: list[str], value: str, source: str, tolerance: float = 1e-6) -> DataFrame:
    """First value by source, number of sources, largest difference from the first, and whether it passes the tolerance."""
    out = df.groupBy(*key).agg(F.min_by(value, source).alias("first_value"), F.count_distinct(source).alias("n_sources"), F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    diff = F.greatest(F.abs(F.col("_hi") - F.col("first_value")), F.abs(F.col("first_value") - F.col("_lo")))
    return out.withColumn("max_abs_diff", diff).withColumn("differs", (F.col("max_abs_diff") > tolerance).cast("int")).drop("_hi", "_lo")


def best_score_tags(df: DataFrame, key: list[str], score: str, tag: str) -> DataFrame:
    """Best score, union of tags and count of duplicates of each key."""
    return df.groupBy(*key).agg(F.max(score).alias("best"), F.array_join(F.array_sort(F.collect_set(tag)), ",").alias("tags"), (F.count("*") - 1).alias("n_duplicates"))


def line_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def line_residuals(df: DataFrame, y: str, x: str, k: int, key: list[str]) -> DataFrame:
    """The k rows with the largest absolute residuals from the fitted line."""
    fit = line_fit(df, y, x)
    res = df.crossJoin(F.broadcast(fit)).withColumn("residual", F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x)))
    return res.orderBy(F.desc(F.abs("residual")), *key).limit(k).select(*key, "residual")


def redundancy(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs, distinct members and mean memberships."""
    pairs = df.select(a, b).distinct()
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b")).withColumn("mean_per_b", F.col("n_pairs") / F.col("n_b"))


def scope_union(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by (a, b), by a, and of all: one aggregate with grouping sets."""
    return df.rollup(a, b).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def block_r2_by_distance(pairs: DataFrame, block_a: str, block_b: str, distance: str, r2: str, edges: list[float]) -> DataFrame:
    """Median r2 of same-block and other pairs in distance bins, and their ratio."""
    from .ranking import linear_quantiles

    same = F.coalesce(F.col(block_a) == F.col(block_b), F.lit(False))
    binned = pairs.select(histogram(F.col(distance), edges).alias("bin"), same.alias("_same"), r2).where("bin IS NOT NULL")
    middle = linear_quantiles(binned, r2, [0.5], ["bin", "_same"]).select("bin", "_same", F.col("q")[0].alias("_m"))
    out = middle.groupBy("bin").agg(F.max(F.when(F.col("_same"), F.col("_m"))).alias("same"), F.max(F.when(~F.col("_same"), F.col("_m"))).alias("other"))
    out = out.join(binned.groupBy("bin").agg(F.count_if("_same").alias("n_same")), "bin").select("bin", "same", "other", "n_same")
    return out.withColumn("ratio", F.when(F.col("other") > 0, F.col("same") / F.col("other")))


def robust_z(df: DataFrame, column: str, name: str = "z") -> DataFrame:
    """(x - median) / scale; scale is IQR / 1.349, else 1.4826 MAD, else the standard deviation, else 1."""
    from .ranking import linear_quantiles

    q = linear_quantiles(df, column, [0.25, 0.5, 0.75]).select(F.col("q").alias("_q")).crossJoin(df.agg(F.stddev_pop(column).alias("_sd")))
    away = df.crossJoin(F.broadcast(q)).select(F.abs(F.col(column) - F.col("_q")[1]).alias("_away"))
    mad = linear_quantiles(away, "_away", [0.5]).select(F.col("q")[0].alias("_mad"))
    scale = F.coalesce(F.nullif((F.col("_q")[2] - F.col("_q")[0]) / 1.349, F.lit(0.0)), F.nullif(1.4826 * F.col("_mad"), F.lit(0.0)), F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0))
    return df.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(mad)).withColumn(name, (F.col(column) - F.col("_q")[1]) / scale).drop("_q", "_sd", "_mad")


def standardised(df: DataFrame, columns: list[str], train: Column, least_sd: float = 1e-6) -> DataFrame:
    """Columns standardised by the training rows; a standard deviation below the least counts as 1."""
    stats = df.agg(*[x for c in columns for x in (F.avg(F.when(train, F.col(c))).alias(f"_m_{c}"), F.stddev_pop(F.when(train, F.col(c))).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < least_sd, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns})
    return out.select(*df.columns)


def exact_sum(df: DataFrame, group: list[str], value: str, name: str = "total") -> DataFrame:
    """Sums rounded once from the exact result, whatever the order of rows.

    A double is a whole number of 53 bits times a power of two.  Tasks split the numbers of
    a batch at once into two halves of few bits and sum these for each power as 64-bit
    integers, which loses nothing up to 2^36 rows; these few rows are added in the shuffle,
    and only the total of a group becomes a double again.  NULL and NaN are left out; an
    infinite value makes the sum infinite or, against the other infinity, NULL.
    """
    from fractions import Fraction

    import numpy as np
    import pandas as pd

    def partial(frames):
        for pdf in frames:
            pdf = pdf.dropna(subset=[value])
            x = pdf[value].to_numpy(float)
            fine = np.isfinite(x)
            part, power = np.frexp(np.where(fine, x, 0.0))
            whole = np.ldexp(part, 53).astype(np.int64)
            rows = pdf[group].assign(_power=power.astype(np.int64) - 53, _high=whole >> 27, _low=whole & ((1 << 27) - 1), _odd=np.where(fine, 0.0, x))
            yield rows.groupby([*group, "_power"], dropna=False, sort=False, as_index=False)[["_high", "_low", "_odd"]].sum()

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        odd = pdf["_odd"].sum(skipna=False)
        exact = sum(((int(h) << 27) + int(low)) * Fraction(2) ** int(p) for p, h, low in zip(pdf["_power"], pdf["_high"], pdf["_low"]))
        try:
            total = float(exact)
        except OverflowError:
            total = float("inf") if exact > 0 else float("-inf")
        return pdf[group].head(1).assign(**{name: total if odd == 0 else odd})

    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    parts = df.select(*group, F.col(value).cast("double")).mapInPandas(partial, f"{fields}, _power long, _high long, _low long, _odd double")
    summed = parts.groupBy(*group, "_power").agg(*[F.sum(c).alias(c) for c in ("_high", "_low", "_odd")])
    return summed.groupBy(*group).applyInPandas(final, f"{fields}, `{name}` double")

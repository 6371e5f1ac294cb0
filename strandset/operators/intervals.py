"""Interval algebra: overlap and nearest joins, merging, coverage, sweeps.

Conventions are named: ``bed`` intervals are half-open on 0-based starts (a 1-based point q
is inside if start < q <= end), ``both`` are closed, ``left`` are half-open [start, end).

Range joins deal intervals to bins and equi-join on (keys, bin), so neither side is ever
compared as a whole with the other.  Scans over a long key go bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running, width_bucket


def _inside(point: Column, start: Column, end: Column, closed: str) -> Column:
    if closed == "bed":
        return (start < point) & (point <= end)
    if closed == "both":
        return (start <= point) & (point <= end)
    if closed == "left":
        return (start <= point) & (point < end)
    raise ValueError(closed)


def _bins(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(width_bucket(start, width), width_bucket(F.greatest(start, end), width)))


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, start: str, end: str, width: float, closed: str = "bed", how: str = "inner") -> DataFrame:
    """Each point with each interval around it (intervals cost one row for each bin they touch)."""
    p = points.withColumn("_bin", width_bucket(F.col(pos), width))
    i = intervals.withColumn("_bin", _bins(F.col(start), F.col(end), width))
    i = i.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_b"), *[c for c in intervals.columns if c not in keys])
    on = (p["_bin"] == i["_b"]) & _inside(p[pos], i[start], i[end], closed)
    for k in keys:
        on = on & (p[k] == i[f"_k_{k}"])
    return p.join(i, on, how).drop("_bin", "_b", *[f"_k_{k}" for k in keys])


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float, closed: str = "both", how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals, each once: in the bin where the later of the two starts."""
    x = a.withColumn("_bin", _bins(F.col(a_span[0]), F.col(a_span[1]), width))
    y = b.withColumn("_b", _bins(F.col(b_span[0]), F.col(b_span[1]), width))
    y = y.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in y.columns if c not in keys])
    lo, hi = F.col(a_span[0]), F.col(a_span[1])
    blo, bhi = F.col(b_span[0]), F.col(b_span[1])
    meets = ((lo <= bhi) & (blo <= hi)) if closed == "both" else ((lo < bhi) & (blo < hi))
    on = (F.col("_bin") == F.col("_b")) & meets & (F.col("_bin") == width_bucket(F.greatest(lo, blo), width))
    for k in keys:
        on = on & (x[k] == y[f"_k_{k}"])
    return x.join(y, on, how).drop("_bin", "_b", *[f"_k_{k}" for k in keys])


def overlap_semi(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float, closed: str = "both") -> DataFrame:
    """Rows of ``a`` that overlap anything in ``b``."""
    return interval_overlap(a, b.select(*keys, *b_span), keys, a_span, b_span, width, closed).select(*a.columns).distinct()


def merge_intervals(intervals: DataFrame, keys: list[str], start: str, end: str, width: float, gap: float = 0, bits: str | None = None) -> DataFrame:
    """Union of intervals that overlap or lie at most ``gap`` apart (0: touching merges).

    ``keys, start, end, n`` and, with ``bits``, the OR of the source masks.
    """
    rows = intervals.select(*keys, F.col(start).alias("start"), F.col(end).alias("end"), *([F.col(bits).alias("bits")] if bits else []))
    # duplicates of a start are one row: the reach before a start needs only the longest
    per = rows.groupBy(*keys, "start").agg(F.max("end").alias("end"), F.count("*").alias("n"), *([F.bit_or("bits").alias("bits")] if bits else []))
    earlier = _reach_before(per, keys, width)
    begun = earlier.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before") + F.lit(gap)), 1).otherwise(0))
    numbered = running(begun, keys, ["start"], width_bucket(F.col("start"), width), {"_group": ("sum", F.col("_new"))})
    return numbered.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), *([F.bit_or("bits").alias("bits")] if bits else [])).drop("_group")


def _reach_before(per: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Adds ``_before``: the largest end among strictly earlier starts of the key (starts are distinct)."""
    rows = per.withColumn("_bucket", width_bucket(F.col("start"), width))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.max("end").over(inside))
    totals = rows.groupBy(*keys, "_bucket").agg(F.max("end").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, "_bucket"]
    carried = totals.select(*[F.col(k).alias(f"_k_{k}") for k in names], F.max("_t").over(earlier).alias("_carry"))
    on = F.lit(True)
    for k in names:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(carried, on, "left").select(*per.columns, F.greatest("_own", "_carry").alias("_before"))


def covered_length(merged: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """Summed length of merged intervals."""
    length = F.col("end") - F.col("start") + (1 if closed else 0)
    return merged.groupBy(*keys).agg(F.sum(length).alias("covered"), F.count("*").alias("n_merged"))


def padded(df: DataFrame, start: str, end: str, before: float, after: float) -> DataFrame:
    return df.withColumns({start: F.col(start) - before, end: F.col(end) + after})


def nearest(points: DataFrame, features: DataFrame, keys: list[str], pos: str, at: str, width: float, tolerance: float | None = None) -> DataFrame:
    """Adds ``left_at, right_at, nearest_at, distance``: the nearest feature of the key at or before, and after.

    On equal distance the left feature counts.  With ``tolerance`` farther ones are NULL
    (an as-of join when only ``left_at`` is used).
    """
    columns = points.columns
    both = points.select(*columns, F.col(pos).alias("_pos"), F.lit(1).alias("_point"), F.lit(None).cast("double").alias("_at")).unionByName(
        features.select(*keys, F.col(at).cast("double").alias("_at")).distinct().select(*keys, F.col("_at").alias("_pos"), F.lit(0).alias("_point"), "_at"), allowMissingColumns=True
    )
    bucket = width_bucket(F.col("_pos"), width)
    scanned = running(both, keys, ["_pos"], bucket, {"_left": ("max", F.col("_at"))})
    scanned = running(scanned, keys, ["_pos"], bucket, {"_right": ("min", F.col("_at"))}, backward=True)
    out = scanned.where("_point = 1")
    left, right = F.col("_pos") - F.col("_left"), F.col("_right") - F.col("_pos")
    take_left = right.isNull() | (left <= right)
    near, gap = F.when(take_left, F.col("_left")).otherwise(F.col("_right")), F.when(take_left, left).otherwise(right)
    ok = F.lit(True) if tolerance is None else gap <= tolerance
    return out.select(*columns, F.col("_left").alias("left_at"), F.col("_right").alias("right_at"), F.when(ok, near).alias("nearest_at"), F.when(ok, gap).alias("distance"))


def distance_to_interval(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, start: str, end: str, width: float, name: str = "distance") -> DataFrame:
    """Adds the distance of each 1-based point to the nearest half-open 0-based interval of its key.

    0 inside; past an interval's end the place after it counts 1; NULL where the key has no
    interval.  Empty intervals are left out.
    """
    columns = points.columns
    spans = intervals.where(F.col(end) > F.col(start)).groupBy(*keys, F.col(start).cast("double").alias("_start")).agg(F.max(end).cast("double").alias("_end"))
    both = points.select(*columns, (F.col(pos) - 1).cast("double").alias("_pos"), F.lit(1).alias("_point")).unionByName(spans.select(*keys, F.col("_start").alias("_pos"), F.lit(0).alias("_point"), "_start", "_end"), allowMissingColumns=True)
    bucket = width_bucket(F.col("_pos"), width)
    scanned = running(both, keys, ["_pos"], bucket, {"_reach": ("max", F.col("_end"))})
    scanned = running(scanned, keys, ["_pos"], bucket, {"_next": ("min", F.col("_start"))}, backward=True)
    outside = F.least(F.col("_pos") - F.col("_reach") + 1, F.col("_next") - F.col("_pos"))
    distance = F.when(F.col("_reach") > F.col("_pos"), F.lit(0.0)).otherwise(outside)
    return scanned.where("_point = 1").select(*columns, distance.alias(name))


def assign_nearest(points: DataFrame, features: DataFrame, keys: list[str], pos: str, at: str, label: str, width: float, name: str = "assigned") -> DataFrame:
    """Each point with the label of the one nearest feature of its key.

    On equal distance the feature before the point counts; of features at one place the
    last label before the point, the first label otherwise.
    """
    near = nearest(points, features, keys, pos, at, width)
    named = features.groupBy(*keys, F.col(at).cast("double").alias("nearest_at")).agg(F.min(label).alias("_first"), F.max(label).alias("_last"))
    out = near.join(named, [*keys, "nearest_at"], "left")
    return out.select(*points.columns, F.when(F.col("nearest_at") < F.col(pos), F.col("_last")).otherwise(F.col("_first")).alias(name), "distance")


def window_summary(assigned: DataFrame, genes: DataFrame, gene: str, pos: str, tss: str, span: tuple[str, str], half: float) -> DataFrame:
    """For each gene with variants: ``m`` of them, window length ``length`` (body and promoter together), ``m_prom`` in ``tss`` +- ``half``, ``m_body`` elsewhere, ``share``."""
    low, high = F.least(F.col(tss) - half, F.col(span[0])), F.greatest(F.col(tss) + half, F.col(span[1]))
    counted = assigned.join(genes.select(gene, tss), gene).groupBy(gene).agg(F.count("*").alias("m"), F.count_if(F.col(pos).between(F.col(tss) - half, F.col(tss) + half)).alias("m_prom"))
    sized = genes.select(gene, (high - low + 1).alias("length"))
    return counted.join(sized, gene).select(gene, "m", "length", "m_prom", (F.col("m") - F.col("m_prom")).alias("m_body"), (F.col("m_prom") / F.col("m")).alias("share"))


def active_count(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, start: str, end: str, width: float) -> DataFrame:
    """Adds ``active``: closed intervals of the key that hold the point, by a sweep of +1 and -1 events."""
    events = intervals.select(*keys, F.col(start).cast("double").alias("_pos"), F.lit(0).alias("_kind"), F.lit(1).alias("_step")).unionByName(
        intervals.select(*keys, F.col(end).cast("double").alias("_pos"), F.lit(2).alias("_kind"), F.lit(-1).alias("_step"))
    )
    marked = points.withColumns({"_pos": F.col(pos).cast("double"), "_kind": F.lit(1), "_step": F.lit(0)})
    # starts come before points, points before ends at the same place
    both = marked.unionByName(events, allowMissingColumns=True).withColumn("_at", F.struct("_pos", "_kind"))
    swept = running(both, keys, ["_at"], width_bucket(F.col("_pos"), width), {"active": ("sum", F.col("_step"))})
    return swept.where("_kind = 1").select(*points.columns, F.col("active").cast("long").alias("active"))


def max_by_tissue(hits: DataFrame, keys: list[str], tissue: str, score: str, tissues: list[str]) -> DataFrame:
    """A column with the largest score of each tissue, and the largest of all."""
    wide = hits.groupBy(*keys).pivot(tissue, tissues).agg(F.max(score))
    return wide.withColumn("max_all", F.greatest(*[F.col(t) for t in tissues]))


def assign_windows(points: DataFrame, genes: DataFrame, links: DataFrame, keys: list[str], pos: str, gene: str, span: tuple[str, str], flank: float, width: float, closed: str = "both") -> DataFrame:
    """``gene`` and point pairs by padded gene body or by linked interval, with a bit mask of the reasons (1 body, 2 link)."""
    body = point_in_interval(points, padded(genes, *span, flank, flank), keys, pos, *span, width, closed).withColumn("source", F.lit(1))
    link = point_in_interval(points, links, keys, pos, *span, width, closed).withColumn("source", F.lit(2))
    names = [*points.columns, gene, "source"]
    return body.select(*names).unionByName(link.select(*names)).groupBy(*points.columns, gene).agg(F.bit_or("source").alias("source"))


def region_build(leads: DataFrame, keys: list[str], pos: str, p: str, flank: float, width: float) -> DataFrame:
    """Merged regions around leads, with the number of leads and the least p."""
    spans = leads.select(*keys, pos, p, (F.col(pos) - flank).alias("start"), (F.col(pos) + flank).alias("end"))
    merged = merge_intervals(spans, keys, "start", "end", width).drop("n")
    hit = point_in_interval(leads.select(*keys, pos, p), merged, keys, pos, "start", "end", max(width, flank), "both")
    return hit.groupBy(*keys, "start", "end").agg(F.count("*").alias("n_leads"), F.min(p).alias("min_p"))


def shifted_null(intervals: DataFrame, keys: list[str], start: str, end: str, extent: dict[str, float], reps: int, seed: str) -> DataFrame:
    """Copies of the intervals moved by hash-drawn offsets within the key's extent (circular)."""
    rep = intervals.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "rep", *keys, start, end), 256), 1, 12), 16, 10).cast("double") / float(16**12)
    size = F.lit(None).cast("double")
    for k, v in extent.items():
        size = F.when(F.col(keys[0]) == k, F.lit(float(v))).otherwise(size)
    moved = F.pmod(F.col(start) + F.floor(draw * size), size)
    return rep.withColumns({end: moved + (F.col(end) - F.col(start)), start: moved})


def factor_sets(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, start: str, end: str, factor: str, top: list, width: float, closed: str = "left") -> DataFrame:
    """``points`` with ``n_factors``, the distinct factors of the intervals around a point, and ``top_bits``.

    Bit k of ``top_bits`` is set where factor ``top[k]`` (63 at most) is around; single
    factors come from it by :func:`factor_indicators`.  A point meets the intervals of its
    bin; what it meets is reduced to distinct factors before they are counted, so many
    intervals of one factor cost one row.
    """
    if len(top) > 63:
        raise ValueError("a set of factors holds 63 at most")
    bit = F.lit(0).cast("long")
    for k, value in enumerate(top):
        bit = F.when(F.col(factor) == value, F.lit(1 << k).cast("long")).otherwise(bit)
    place = [*keys, pos]
    places = points.select(*place).distinct()
    met = point_in_interval(places, intervals.select(*keys, start, end, factor), keys, pos, start, end, width, closed)
    sets = met.select(*place, factor, bit.alias("_bit")).distinct().groupBy(*place).agg(F.count(factor).alias("n_factors"), F.bit_or("_bit").alias("top_bits"))
    return points.join(sets, place, "left").fillna({"n_factors": 0, "top_bits": 0})


def factor_indicators(top: list, bits: str = "top_bits", prefix: str = "factor_") -> list[Column]:
    """A 0/1 column for each listed factor of :func:`factor_sets`."""
    return [F.expr(f"CAST(shiftright({bits}, {k}) & 1 AS INT)").alias(f"{prefix}{value}") for k, value in enumerate(top)]

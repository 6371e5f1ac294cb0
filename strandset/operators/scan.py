"""Ordered scans that do not need a whole key in one task.

A running aggregate over a long key (a chromosome, or no key at all) is made in two steps:
inside buckets of the ordering column, and over one summary row a bucket.  Only the
summaries of a key meet in one window, so a hot key is spread over its buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, so that what reads the table twice does not make it twice."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            path = "file://" + tempfile.mkdtemp(prefix="strandset-")
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint()


def task_count(spark: SparkSession, rows: float, each: int = 1_000_000) -> int:
    """Tasks of about ``each`` rows, at least as many as a shuffle has anyway."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


def width_bucket(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width)).cast("long")


def quantile_bucket(df: DataFrame, column: str, buckets: int = 64, few: int = 50_000) -> Column:
    """Bucket numbers cut at approximate quantiles (at most ``buckets`` numbers reach the driver); one bucket holds a few rows."""
    if df.count() <= few:
        return F.lit(0)
    knots = sorted(set(df.stat.approxQuantile(column, [k / buckets for k in range(1, buckets)], 0.01)))
    if not knots:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(k) for k in knots]), lambda k: k <= F.col(column)))


def running(df: DataFrame, keys: list[str], order: list[str], bucket: Column, aggregates: dict[str, tuple[str, Column]], exclusive: bool = False, backward: bool = False) -> DataFrame:
    """Adds running ``sum``, ``max`` or ``min`` columns over ``keys`` by ``order``.

    ``aggregates`` maps a new column to (kind, value).  ``bucket`` must not decrease in the
    direction of ``order``.  Rows with equal ``order`` are not told apart: they all see the
    same, which includes all of them unless ``exclusive``.
    """
    merge = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
    apply = {"sum": F.sum, "max": F.max, "min": F.min}
    df = df.withColumn("_bucket", bucket)
    directed = [F.desc(c) if backward else F.asc(c) for c in order]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*directed)
    peers = Window.partitionBy(*keys, "_bucket", *order)
    for name, (kind, value) in aggregates.items():
        if exclusive and kind != "sum":
            raise ValueError("only sums can leave out the rows at the same place")
        through = apply[kind](value).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        if exclusive:
            through = F.coalesce(through, F.lit(0)) - F.coalesce(F.sum(value).over(peers), F.lit(0))
        df = df.withColumn(f"_in_{name}", through).withColumn(f"_v_{name}", value)
    totals = df.groupBy(*keys, "_bucket").agg(*[apply[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in aggregates.items()])
    before = Window.partitionBy(*keys).orderBy(F.desc("_bucket") if backward else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, "_bucket"]
    carried = totals.select(*[F.col(k).alias(f"_k_{k}") for k in names], *[apply[kind](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in aggregates.items()])
    condition = F.lit(True)
    for k in names:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = [c for c in df.columns if not c.startswith(("_in_", "_v_", "_bucket"))]
    return df.join(carried, condition, "left").select(*out, *[merge[kind](F.col(f"_c_{name}"), F.col(f"_in_{name}")).alias(name) for name, (kind, _) in aggregates.items()])

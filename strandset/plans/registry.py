"""Registration of queries with their SQL equivalents, and the stand-in tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def micros(c: str) -> Column:
    """Microseconds since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({c} AS timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with integer places: ``us`` and the end of a span of ``value`` seconds, ``us_end``."""
    length = F.round(F.col("value") * 100).cast("long") * 10000
    return table(spark, sf_dir, "events").withColumn("us", micros("ts")).withColumn("us_end", F.col("us") + length)


EVENTS_SQL = "(SELECT *, epoch_us(ts) AS us, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 10000 AS us_end FROM events)"


def dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dosage stand-in: ``person, variant, ds``."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("person"), F.col("l_partkey").alias("variant")).agg(F.least(F.lit(2.0), F.sum("l_discount") * 10).alias("ds"))


DOSAGE_SQL = "(SELECT o_custkey AS person, l_partkey AS variant, least(2e0, sum(l_discount) * 10) AS ds FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
MEMBERS_SQL = "(SELECT p_partkey AS variant, p_brand AS gene, 25 * pow(1 - least(p_size, 50) / 1e2, 24) AS w FROM part)"


def vectors(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"d{k}") for k in range(dims)])


def vectors_sql(dims: int) -> str:
    return "(SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS d{k}" for k in range(dims)) + " FROM embeddings)"

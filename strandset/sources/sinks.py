"""Writers: committed output, resume guards, chunks, group files, fingerprints, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a committed output is there (Spark's ``_SUCCESS`` mark)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet that refuses to replace anything."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_or_resume(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes unless a completed output is there; an unfinished one is replaced."""
    spark = df.sparkSession
    if not is_complete(spark, path):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def chunk_number(df: DataFrame, group: list[str], order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Chunk numbers (from 1) of ``size`` ordered rows in each group."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, F.ceil(rank / F.lit(float(size))).cast("long"))


def group_lines(members: DataFrame, gene: str, key: str, anno: str, weight: str, order: list[str]) -> DataFrame:
    """Group-file lines: ``gene var ...``, ``gene anno ...``, ``gene weight ...``, equal in count."""
    cells = F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("_k"), F.col(anno).alias("_a"), F.format_string("%s", F.col(weight)).alias("_w"))))
    rows = members.groupBy(gene).agg(cells.alias("c"))

    def line(kind: str, field: str):
        return F.concat_ws(" ", F.col(gene), F.lit(kind), F.array_join(F.transform("c", lambda s: s[field].cast("string")), " "))

    return rows.select(F.col(gene).alias("gene"), F.posexplode(F.array(line("var", "_k"), line("anno", "_a"), line("weight", "_w"))).alias("ord", "line"))


def write_group_file(members: DataFrame, path: str, gene: str, key: str, anno: str, weight: str, order: list[str]) -> None:
    lines = group_lines(members, gene, key, anno, weight, order)
    lines.repartitionByRange("gene").sortWithinPartitions("gene", "ord").select("line").write.text(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that does not depend on row order or partitioning: count and two sums of row digests."""
    text = F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i:04d}") for i, c in enumerate(sorted(df.columns))]), {"ignoreNullFields": "false"}), 256)
    part = lambda a: F.conv(F.substring(text, a, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.sum(part(1)).alias("h1"), F.sum(part(16)).alias("h2")).select("n", F.sha2(F.concat_ws(":", "n", "h1", "h2"), 256).alias("sha256"))


def ledger(df: DataFrame, checks: dict) -> DataFrame:
    """Named counts of conditions over a table, one row a check (gate reports)."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in ["rows", *checks]])).alias("r")).select("r.*")

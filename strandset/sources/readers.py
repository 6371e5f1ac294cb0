"""Typed readers of the domain's text formats; schemas are declared, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import attribute, bare_chrom, nullify


class SchemaError(ValueError):
    pass


def require_columns(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Fails unless the columns are there (all and in this order if ``exact``)."""
    missing = [c for c in columns if c not in df.columns]
    if missing or (exact and df.columns != columns):
        raise SchemaError(f"expected {columns}, got {df.columns}")
    return df


def same_schema(frames: dict[str, DataFrame]) -> None:
    """Fails on the first table whose schema differs from the first one's."""
    first, *others = frames.items()
    for name, df in others:
        if df.schema.jsonValue() != first[1].schema.jsonValue():
            raise SchemaError(f"{name} differs from {first[0]}")


def delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t", header: bool = True, missing: list[str] | None = None) -> DataFrame:
    """Delimited text (plain or gzip), read strictly; sentinel texts become NULL before the cast."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in want])
    raw = spark.read.schema(text).options(sep=sep, header=header, mode="FAILFAST", enforceSchema=False).csv(path)
    return raw.select(*[nullify(F.col(f"`{f.name}`"), missing).cast(f.dataType).alias(f.name) for f in want])


def coerced(df: DataFrame, column: str, to: str) -> tuple[DataFrame, DataFrame]:
    """The column cast with failures as NULL, and one row with how many failed."""
    tried = df.withColumn("_t", F.col(column).try_cast(to))
    failures = tried.agg(F.count_if(F.col(column).isNotNull() & F.col("_t").isNull()).alias("n_failed"))
    return tried.withColumn(column, F.col("_t")).drop("_t"), failures


def zip_member(spark: SparkSession, path: str, member: str | None = None, lines_per_row: int = 1) -> DataFrame:
    """Lines of a member of zip archives (a gzip inside is opened); an archive is one task, read as a stream."""
    import pyarrow as pa

    def run(batches):
        import gzip
        import io
        import zipfile

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for m in z.namelist():
                        if member and m != member:
                            continue
                        with z.open(m) as f:
                            stream = gzip.open(f) if m.endswith(".gz") else f
                            rows, number = [], 0
                            for line in stream:
                                number += 1
                                rows.append((name, m, number, line.decode().rstrip("\r\n")))
                                if len(rows) >= 10_000:
                                    yield _lines(rows, pa)
                                    rows = []
                            if rows:
                                yield _lines(rows, pa)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, member string, line_number long, line string")


def _lines(rows, pa):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3])], ["path", "member", "line_number", "line"])


def from_end(line: Column, sep: str, offset: int) -> Column:
    """A field of a line of varying width, counted from the end (1 is the last)."""
    return F.element_at(F.split(line, sep), -offset)


def lines(spark: SparkSession, path: str | DataFrame, comment: str = "#") -> DataFrame:
    """Lines of text files, or of a table that has them as ``value`` (:func:`strandset.sources.indexed.indexed_lines`)."""
    text = path.select("value") if isinstance(path, DataFrame) else spark.read.text(path)
    return text.where(~F.col("value").startswith(comment)) if comment else text


def vcf_sites(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``chrom, pos, id, ref, alt, filter, info`` (a map) of variant lines, one row an alternative allele."""
    part = F.split("value", "\t")
    rows = lines(spark, path).select(*[F.get(part, F.lit(i)).alias(n) for i, n in enumerate(["chrom", "pos", "id", "ref", "alts", "qual", "filter", "info"])])
    return rows.select(bare_chrom(F.col("chrom")).alias("chrom"), F.col("pos").cast("long").alias("pos"), nullify(F.col("id")).alias("id"), F.upper("ref").alias("ref"), F.explode(F.split(F.upper("alts"), ",")).alias("alt"), "filter", F.str_to_map("info", F.lit(";"), F.lit("=")).alias("info"))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header line."""
    header = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return header.value.split("\t")[9:] if header else []


def vcf_cells(spark: SparkSession, path: str | DataFrame, fields: list[str]) -> DataFrame:
    """``chrom, pos, ref, alt, sample_idx`` and the named cell fields of biallelic lines."""
    part = F.split("value", "\t")
    base = lines(spark, path).select(bare_chrom(F.get(part, F.lit(0))).alias("chrom"), F.get(part, F.lit(1)).cast("long").alias("pos"), F.get(part, F.lit(3)).alias("ref"), F.get(part, F.lit(4)).alias("alt"), F.split(F.get(part, F.lit(8)), ":").alias("_format"), F.posexplode(F.slice(part, F.lit(10), F.greatest(F.size(part) - 9, F.lit(0)))).alias("sample_idx", "_cell"))
    cell = F.split("_cell", ":")
    values = [F.when(F.array_position("_format", f) > 0, nullify(F.get(cell, (F.array_position("_format", f) - 1).cast("int")))).alias(f.lower()) for f in fields]
    return base.where(~F.col("alt").contains(",")).select("chrom", "pos", "ref", "alt", "sample_idx", *values)


def info_number(name: str) -> Column:
    return F.col("info")[name].try_cast("double")


def region(df: DataFrame, chrom: str, low: int, high: int) -> DataFrame:
    """A closed range of one chromosome (pushed to the scan of a partitioned table)."""
    return df.where((F.col("chrom") == chrom) & F.col("pos").between(low, high))


def gtf_genes(spark: SparkSession, path: str | DataFrame, biotype: str | None = "protein_coding") -> DataFrame:
    """``chrom, start, end, strand, gene_id, gene_name, tss`` of gene lines."""
    part = F.split("value", "\t")
    rows = lines(spark, path).where(F.get(part, F.lit(2)) == "gene").select(bare_chrom(F.get(part, F.lit(0))).alias("chrom"), F.get(part, F.lit(3)).cast("long").alias("start"), F.get(part, F.lit(4)).cast("long").alias("end"), F.get(part, F.lit(6)).alias("strand"), F.get(part, F.lit(8)).alias("_a"))
    out = rows.withColumns({"gene_id": attribute(F.col("_a"), "gene_id"), "gene_name": attribute(F.col("_a"), "gene_name"), "biotype": F.coalesce(attribute(F.col("_a"), "gene_type"), attribute(F.col("_a"), "gene_biotype")), "tss": F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))}).drop("_a")
    return out.where(F.col("biotype") == biotype) if biotype else out


def bed(spark: SparkSession, path: str | DataFrame, columns: dict[str, int] | None = None, chroms: list[str] | None = None) -> DataFrame:
    """``chrom, start, end`` and named extra columns (0-based field numbers) of interval lines."""
    part = F.split("value", "\t")
    names = {"chrom": 0, "start": 1, "end": 2} | (columns or {})
    rows = lines(spark, path).where(~F.col("value").rlike("^(track|browser)"))
    out = rows.select(*[F.get(part, F.lit(i)).alias(n) for n, i in names.items()]).withColumns({"chrom": bare_chrom(F.col("chrom")), "start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    return out.where(F.col("chrom").isin(chroms)) if chroms else out


def group_file(spark: SparkSession, path: str) -> DataFrame:
    """``gene, ord, key, anno, weight`` of group files (lines of kind var, anno, weight with equal counts)."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(part, F.lit(0)).alias("gene"), F.get(part, F.lit(1)).alias("kind"), F.slice(part, F.lit(3), F.size(part)).alias("v"))
    wide = rows.groupBy("gene").agg(*[F.first(F.when(F.col("kind") == k, F.col("v")), ignorenulls=True).alias(k) for k in ("var", "anno", "weight")])
    sizes = (F.size("var") == F.coalesce(F.size("anno"), F.size("var"))) & (F.coalesce(F.array_size("weight"), F.size("var")) == F.size("var"))
    sound = wide.withColumn("var", F.when(sizes, F.col("var")).otherwise(F.raise_error(F.concat(F.lit("unequal counts in group "), "gene"))))
    cells = F.posexplode(F.transform("var", lambda v, i: F.struct(v.alias("key"), F.get("anno", i).alias("anno"), F.get("weight", i).try_cast("double").alias("weight"))))
    return sound.select("gene", cells.alias("ord", "m")).select("gene", "ord", "m.key", "m.anno", "m.weight")


def key_values(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.schema("key string, value string").options(sep=sep).csv(path)


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, v`` triples; comments and the size line are left out."""
    part = F.split(F.trim("value"), r"\s+")
    # the size line is the first that is no comment: by file, then by its place in the file
    part_of = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    rows = spark.read.text(path).select("value", part_of.alias("at")).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    heads = rows.groupBy("at.f").agg(F.min("at").alias("at")).select("at")
    rows = rows.join(heads, "at", "left_anti").select(part.alias("p"))
    return rows.where(F.size("p") == 3).select(F.get("p", F.lit(0)).cast("long").alias("i"), F.get("p", F.lit(1)).cast("long").alias("j"), F.get("p", F.lit(2)).cast("double").alias("v"))


def square_matrix(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``i, j, r`` of a raw little-endian float32 square matrix file; tasks read stretches of its rows by offset."""
    return _matrix_rows(spark, path, 0, n, n, "<f4").select(F.col("i"), F.col("j"), F.col("value").alias("r"))


#: Cells of a matrix that are one row of the scan's plan, and that a batch holds.
STRETCH_CELLS = 4_000_000
BATCH_CELLS = 200_000


def _matrix_rows(spark: SparkSession, path: str, offset: int, rows: int, width: int, dtype: str) -> DataFrame:
    """``i, j, value`` of a row-major array of numbers that begins at ``offset`` of a file of any size."""
    import numpy as np
    import pyarrow as pa

    from .indexed import Ranges

    item = np.dtype(dtype).itemsize
    per, step = max(1, STRETCH_CELLS // max(1, width)), max(1, BATCH_CELLS // max(1, width))

    def run(batches):
        file = Ranges(path)
        for batch in batches:
            for stretch in batch.column(0).to_pylist():
                for first in range(stretch * per, min(rows, (stretch + 1) * per), step):
                    n = min(step, rows - first, (stretch + 1) * per - first)
                    raw = file.at(offset + first * width * item, n * width * item)
                    if len(raw) != n * width * item:
                        raise SchemaError(f"{path} is too short for its shape")
                    x = np.frombuffer(raw, dtype).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(first, first + n, dtype=np.int64), width)), pa.array(np.tile(np.arange(width, dtype=np.int64), n)), pa.array(x)], ["i", "j", "value"])

    stretches = -(-rows // per)
    return spark.range(0, stretches, 1, max(1, stretches)).mapInArrow(run, "i long, j long, value double")


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Chunks by column name; columns that one lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def header_dispatched(spark: SparkSession, paths: list[str], variants: dict[str, dict[str, str]], schema: str, sep: str = "\t") -> DataFrame:
    """Files of different producers: the variant whose columns a file's header has gives its renaming."""
    want = T.StructType.fromDDL(schema)
    out = []
    for path in paths:
        header = spark.read.text(path).first().value.split(sep)
        name = next((v for v, names in variants.items() if set(names) <= set(header)), None)
        if name is None:
            raise SchemaError(f"no known header in {path}: {header}")
        raw = spark.read.options(sep=sep, header=True, inferSchema=False, mode="FAILFAST").csv(path)
        named = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in variants[name].items()])
        out.append(named.select(*[nullify(F.col(f.name)).cast(f.dataType).alias(f.name) for f in want]))
    return union_of(out)


def nested_json(spark: SparkSession, path: str) -> DataFrame:
    """``run, axis, band, model, value`` of nested result documents (four levels of objects)."""
    level = "map<string,map<string,map<string,map<string,double>>>>"
    out = spark.read.option("wholetext", True).text(path).select(F.from_json("value", level).alias("m"))
    for name in ("run", "axis", "band"):
        out = out.select(*[c for c in out.columns if c != "m"], F.explode("m").alias(name, "m"))
    return out.select("run", "axis", "band", F.explode("m").alias("model", "value"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, modified`` of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def members_only(spark: SparkSession, path: str, column: str, keys: list) -> DataFrame:
    """A Parquet scan with a pushed membership filter."""
    return spark.read.parquet(path).where(F.col(column).isin(keys))


def array_file(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, value`` of one npy file of any size with one or two dimensions; tasks read stretches of its rows by offset."""
    import io

    import numpy as np

    from .indexed import Ranges

    head = io.BytesIO(Ranges(path).at(0, 1 << 16))
    shape, columns_first, dtype = (np.lib.format.read_array_header_1_0, np.lib.format.read_array_header_2_0)[np.lib.format.read_magic(head)[0] - 1](head)
    if dtype.kind not in "fiub" or len(shape) not in (1, 2):
        raise SchemaError(f"{path} holds {dtype} of shape {shape}, not a vector or matrix of numbers")
    rows, width = (shape[0], 1) if len(shape) == 1 else shape
    if columns_first and len(shape) == 2:
        return _matrix_rows(spark, path, head.tell(), width, rows, dtype.str).select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return _matrix_rows(spark, path, head.tell(), rows, width, dtype.str)


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """``array, i, j, value`` of one- and two-dimensional numeric arrays in small npy and npz files (a file is one task);
    a large npy file is :func:`array_file`."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        import io

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                whole = {k: got[k] for k in got.files} if hasattr(got, "files") else {name.rsplit("/", 1)[-1].removesuffix(".npy"): got}
                for key, x in whole.items():
                    x = x.astype(np.float64).reshape(len(x), -1)
                    for at in range(0, len(x), 10_000):
                        part = x[at : at + 10_000]
                        i, j = np.indices(part.shape)
                        yield pa.RecordBatch.from_arrays([pa.array([key]).take(pa.array(np.zeros(part.size, np.int32))), pa.array(i.ravel() + at), pa.array(j.ravel()), pa.array(part.ravel())], ["array", "i", "j", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "array string, i long, j long, value double")


def bigwig(spark: SparkSession, path: str, regions: list[str] | None = None) -> DataFrame:
    """``chrom, start, end, value`` (half-open, 0-based) of bigWig signal files, blocks over ``regions`` only if given.

    Blocks are found in the files' indexes and read by offset in many tasks; values at points
    are :func:`strandset.sources.indexed.signal_at`.
    """
    from .indexed import read_signal, signal_blocks

    return read_signal(signal_blocks(spark, path, regions))

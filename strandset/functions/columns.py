"""Derived columns and predicates of variant, annotation and sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text that stands for a missing value in source files.  Fixed values.
MISSING = ["", "na", "nan", ".", "null", "none"]


def nullify(c: Column, codes: list[str] | None = None) -> Column:
    """Sentinel texts become NULL."""
    return F.when(F.lower(F.trim(c)).isin(codes or MISSING), None).otherwise(F.trim(c))


# --- keys and alleles --------------------------------------------------------------------


def bare_chrom(c: Column) -> Column:
    return F.regexp_replace(c, "^chr", "")


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", bare_chrom(chrom), pos.cast("string"), F.upper(ref), F.upper(alt))


def parse_key(key: Column) -> Column:
    """``struct(chrom, pos, ref, alt)``, or NULL unless four sound parts with different alleles."""
    part = F.split(key, ":")
    ref, alt = F.upper(F.get(part, F.lit(2))), F.upper(F.get(part, F.lit(3)))
    sound = key.rlike("^(chr)?[^:]+:[0-9]+:[ACGTNacgtn]+:[ACGTNacgtn]+$") & (ref != alt)
    fields = F.struct(bare_chrom(F.get(part, F.lit(0))).alias("chrom"), F.get(part, F.lit(1)).try_cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt"))
    return F.when(sound, fields)


def complement(allele: Column) -> Column:
    return F.reverse(F.translate(F.upper(allele), "ACGTN", "TGCAN"))


def palindromic(ref: Column, alt: Column) -> Column:
    """A/T and C/G pairs look alike on both strands."""
    return F.concat(F.upper(ref), F.upper(alt)).isin("AT", "TA", "CG", "GC")


def orientation(ref: Column, alt: Column, to_ref: Column, to_alt: Column) -> Column:
    """``struct(sign, label)`` of one allele pair against another; the first that fits counts."""
    kinds = [("direct", 1, ref, alt), ("swap", -1, alt, ref), ("rc", 1, complement(ref), complement(alt)), ("swap_rc", -1, complement(alt), complement(ref))]
    out: Column = F.lit(None).cast("struct<sign:int,label:string>")
    for label, sign, a, b in reversed(kinds):
        out = F.when((a == to_ref) & (b == to_alt), F.struct(F.lit(sign).alias("sign"), F.lit(label).alias("label"))).otherwise(out)
    return out


def strip_version(c: Column) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1))


def normalise_id(c: Column) -> Column:
    """``x_x`` becomes ``x`` (by its last part), any other id the last of its ``_`` parts."""
    return F.element_at(F.split(c, "_"), -1)


# --- frequencies and dosages -------------------------------------------------------------


def folded(af: Column) -> Column:
    return F.least(af, 1.0 - af)


def folded_count(mac: Column, n: Column) -> Column:
    return F.least(mac, 2 * n - mac)


def dosage_variance(af: Column, r2: Column) -> Column:
    return 2.0 * af * (1.0 - af) * r2


def inverse_sd_weight(af: Column, eps: float = 1e-6) -> Column:
    return F.pow(af * (1.0 - af) + eps, F.lit(-0.5))


def minor_dosage(ds: Column, af: Column) -> Column:
    return F.when(af > 0.5, 2.0 - ds).otherwise(ds)


def minor_alleles(alleles: Column, af: Column) -> Column:
    """Haplotype alleles 0/1 flipped where the counted allele is the common one; missing (-1) stays."""
    return F.when(af > 0.5, F.transform(alleles, lambda a: F.when(a >= 0, 1 - a).otherwise(a))).otherwise(alleles)


def hard_call(gp: Column, threshold: float = 0.9) -> Column:
    """The genotype whose probability reaches the threshold, else NULL."""
    top = F.array_max(gp)
    return F.when(top >= threshold - 1e-12, (F.array_position(gp, top) - 1).cast("int"))


def call_from_gt(gt: Column) -> Column:
    part = F.split(gt, "[|/]")
    return F.when(F.exists(part, lambda p: p == "."), None).otherwise(F.aggregate(part, F.lit(0), lambda a, p: a + p.try_cast("int")))


# --- bands, flags, coding ----------------------------------------------------------------


def band(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Left-closed bands: ``labels[k]`` from ``edges[k - 1]`` up to below ``edges[k]``."""
    assert len(labels) == len(edges) + 1
    out = F.when(c.isNull(), None)
    for edge, label in zip(edges, labels):
        out = out.when(c < edge, label)
    return out.otherwise(labels[-1])


def digitize(c: Column, edges: list[float], right: bool = False) -> Column:
    """Number of edges at or below the value (strictly below it if ``right``)."""
    return reduce(lambda a, e: a + ((c > e) if right else (c >= e)).cast("int"), edges, F.lit(0))


def with_missing_flags(df: DataFrame, columns: list[str], fill: float | None = None) -> DataFrame:
    out = {f"{c}_na": F.col(c).isNull().cast("int") for c in columns}
    if fill is not None:
        out |= {c: F.coalesce(F.col(c), F.lit(fill)) for c in columns}
    return df.withColumns(out)


def one_hot(df: DataFrame, column: str, levels: list[str], other: str | None = None) -> DataFrame:
    flags = {f"{column}_{lv}": F.coalesce((F.col(column) == lv), F.lit(False)).cast("int") for lv in levels}
    if other:
        flags[f"{column}_{other}"] = (~F.coalesce(F.col(column).isin(levels), F.lit(False))).cast("int")
    return df.withColumns(flags)


def indicators(c: Column, levels: list[str], sep: str = ",") -> list[Column]:
    """A 0/1 column for each level of a separated list."""
    return [F.coalesce(F.array_contains(F.split(c, sep), lv), F.lit(False)).cast("int").alias(lv) for lv in levels]


def stronger(gain: Column, loss: Column) -> Column:
    """``struct(value, direction)`` of the larger magnitude; gains win ties."""
    up = F.abs(gain) >= F.abs(loss)
    return F.struct(F.greatest(F.abs(gain), F.abs(loss)).alias("value"), F.when(up, 1).otherwise(-1).alias("direction"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def neg_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def outside(pos: Column, low: int, high: int) -> Column:
    return ~pos.between(low, high)


def all_or_nothing(df: DataFrame, columns: list[str], flag: str = "incomplete") -> DataFrame:
    """If any column is NULL all become NULL; ``flag`` tells none (0), partly (1), wholly missing (2)."""
    missing = reduce(lambda a, c: a + F.col(c).isNull().cast("int"), columns, F.lit(0))
    df = df.withColumn(flag, F.when(missing == 0, 0).when(missing < len(columns), 1).otherwise(2))
    return df.withColumns({c: F.when(F.col(flag) == 0, F.col(c)) for c in columns})


def first_reason(rules: list[tuple[str, Column]], passed: str = "pass") -> Column:
    """The first rule that a row breaks: each row falls under exactly one reason."""
    out = F.when(F.lit(False), "")
    for name, broken in rules:
        out = out.when(F.coalesce(broken, F.lit(True)), name)
    return out.otherwise(passed)


# --- packed text -------------------------------------------------------------------------


def info_map(c: Column) -> Column:
    """``k=v;flag`` to a map; flags map to NULL."""
    return F.str_to_map(c, F.lit(";"), F.lit("="))


def packed_records(c: Column, fields: list[str], record_sep: str = ",", field_sep: str = r"\|") -> Column:
    """Records of separated fields to an array of structs."""
    return F.transform(F.split(c, record_sep), lambda r: F.struct(*[nullify(F.get(F.split(r, field_sep), F.lit(i))).alias(f) for i, f in enumerate(fields)]))


def attribute(attrs: Column, name: str) -> Column:
    """A quoted attribute of an annotation line."""
    got = F.regexp_extract(attrs, f'{name} "([^"]+)"', 1)
    return F.when(got != "", got)


# --- phase -------------------------------------------------------------------------------


def phase_product(h1j: Column, h2j: Column, h1k: Column, h2k: Column) -> Column:
    """Q = (h1j - h2j)(h1k - h2k): positive for cis, negative for trans double heterozygotes."""
    return (h1j - h2j) * (h1k - h2k)

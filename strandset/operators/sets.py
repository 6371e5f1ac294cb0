"""Set comparisons of tables and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Products that a task of nearest neighbours holds at a time, and candidates whose distances it takes at a time.
CELLS, CANDIDATES = 1_000_000, 65_536


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b)).cast("double"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with the counts by which two tables differ as multisets; empty if they are equal."""
    cols = a.columns
    rows = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    return rows.groupBy(*cols).agg(F.sum("_d").alias("difference")).where("difference <> 0")


def tolerance_difference(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """How many rows differ in each column beyond a tolerance (missing equals missing), and unmatched keys."""
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(1).alias("_right"))
    on = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.lit(True))
    joined = a.withColumn("_left", F.lit(1)).join(right, on, "full")
    both = F.col("_left").isNotNull() & F.col("_right").isNotNull()

    def differs(v: str) -> Column:
        x, y = F.col(v).cast("double"), F.col(f"_b_{v}").cast("double")
        x, y = F.nanvl(x, F.lit(None)), F.nanvl(y, F.lit(None))
        return both & F.coalesce(F.abs(x - y) > tolerance, x.isNull() != y.isNull())

    one = joined.agg(F.count_if(~both).alias("_unmatched"), *[F.count_if(differs(v)).alias(v) for v in values])
    rows = [F.struct(F.lit(v).alias("column"), F.col(v).alias("n_different")) for v in values] + [F.struct(F.lit("(unmatched keys)").alias("column"), F.col("_unmatched").alias("n_different"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_vectors(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    """Groups of equal rounded vectors with their sizes."""
    rounded = [(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) for c in columns]
    return df.select(*rounded).groupBy(*columns).agg(F.count("*").alias("n"))


def nearest_neighbours(df: DataFrame, key: str, vector: str, k: int, queries: DataFrame | None = None, block_rows: int = 20_000) -> DataFrame:
    """The k nearest vectors (Euclidean) of each query, exactly.

    Queries and vectors are dealt to blocks of at most about ``block_rows``; each pair of a query block and a vector
    block is one task of matrix products that returns k candidates a query, and the best k of those remain.
    No row is paired with another as a row, and a task holds a million products at a time, whatever the table.
    Products only choose; the distances of the chosen are sums of squared differences, so copies are at distance zero.
    """
    import numpy as np
    import pandas as pd

    queries = df if queries is None else queries
    q_blocks = max(1, -(-queries.count() // block_rows))
    v_blocks = max(-(-16 // q_blocks), -(-df.count() // block_rows))
    block = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), block(q_blocks).alias("qb"), deal(v_blocks).alias("vb"), F.lit(True).alias("query"))
    right = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), block(v_blocks).alias("vb"), deal(q_blocks).alias("qb"), F.lit(False).alias("query"))
    kind = df.schema[key].dataType.simpleString()

    def nearest(part: np.ndarray, own: np.ndarray, b: np.ndarray, norms: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        d = part @ b.T
        d *= -2
        d += norms
        d[own[:, None] == ids] = np.inf
        slack = 1e-12 * ((part**2).sum(1) + norms[np.isfinite(norms)].max(initial=0.0))
        least = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
        rows, found = np.nonzero((d <= (least + slack)[:, None]) & (d < np.inf))
        exact = np.concatenate([((part[rows[i : i + CANDIDATES]] - b[found[i : i + CANDIDATES]]) ** 2).sum(1) for i in range(0, len(rows), CANDIDATES)] or [np.zeros(0)])
        # order by distance, then id, so ties are the same however rows are dealt
        at = np.lexsort((ids[found], exact, rows))
        rows, found, exact = rows[at], found[at], exact[at]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return pd.DataFrame({"query_id": own[rows[best]], "neighbour": ids[found[best]], "distance": np.sqrt(exact[best])})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["query"].to_numpy(bool)
        if asked.all() or not asked.any():
            return pd.DataFrame({"query_id": [], "neighbour": [], "distance": []})
        ids, v = pdf.id.to_numpy(), pdf.v.to_numpy()
        a, b = np.stack(v[asked]).astype(float), np.stack(v[~asked]).astype(float)
        own, ids, norms = ids[asked], ids[~asked], (b**2).sum(1)
        step = max(1, CELLS // len(b))
        return pd.concat([nearest(a[i : i + step], own[i : i + step], b, norms, ids) for i in range(0, len(a), step)])

    near = left.unionByName(right).groupBy("qb", "vb").applyInPandas(one, f"query_id {kind}, neighbour {kind}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

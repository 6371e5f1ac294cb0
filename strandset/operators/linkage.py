"""Linkage by blocks and streams, agglomeration by chains, spectral and consensus clustering."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import complete_teams, components
from .scan import quantile_bucket, running, settle

#: Rows of a block, and rows on either side of a border between blocks that are compared.
BLOCK, BORDER = 2000, 200


def unit_rows(vectors: list) -> np.ndarray:
    """Centred rows of length one, so that products are correlations; constant rows are zero."""
    x = np.array([list(v) for v in vectors], float)
    x -= x.mean(1, keepdims=True)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)


def block_teams(x: np.ndarray, threshold: float) -> list[int]:
    """The first row of each row's team: complete linkage of unit rows, every pair of a team above ``threshold`` in r2."""
    return complete_teams(np.clip(x @ x.T, -1, 1) ** 2, threshold)


def border_counts(tail: np.ndarray, head: np.ndarray, threshold: float) -> tuple[int, int, int, int]:
    """Pairs across a border: tested, above the threshold, and the rows on its left and right that are in one."""
    hits = np.clip(tail @ head.T, -1, 1) ** 2 > threshold
    return hits.size, int(hits.sum()), int(hits.any(1).sum()), int(hits.any(0).sum())


BORDER_SCHEMA = "tested_pairs long, high_pairs long, left_involved long, right_involved long"


def numbered_in_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` (without other columns than these) with ``idx``, from 0 by ``order`` in each group; ``order`` tells rows apart."""
    rows = settle(df.select(*group, *order))
    counted = running(rows, group, order, quantile_bucket(rows, order[0]), {"_n": ("sum", F.lit(1))})
    return counted.withColumn("idx", (F.col("_n") - 1).cast("long")).drop("_n")


def blocked_linkage(df: DataFrame, group: list[str], key: str, pos: str, vector: str, threshold: float = 0.8, block: int = BLOCK, border: int = BORDER) -> tuple[DataFrame, DataFrame]:
    """Complete linkage inside blocks of ``block`` rows by position, and what the borders between blocks cut.

    Teams: ``group, key, idx, block, team`` (the team's first ``idx``).  Borders: ``group,
    border`` (the block on its left) and counts of pairs of the last and first ``border``
    rows on both sides.  A block is one task, whatever the length of the group; with a block
    that holds the whole group this is plain complete linkage.
    """
    rows = df.select(*group, pos, key, vector).join(numbered_in_group(df, group, [pos, key]).drop(pos), [*group, key])
    rows = settle(rows.withColumn("block", F.expr(f"idx div {block}")))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*group, key])

    def teams(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        own = block_teams(unit_rows(pdf[vector].tolist()), threshold)
        return pdf[[*group, key, "idx", "block"]].assign(team=pdf["idx"].to_numpy()[own])

    found = rows.groupBy(*group, "block").applyInPandas(teams, f"{fields}, idx long, block long, team long")
    last = rows.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("block").alias("_b")).agg(F.max("idx").alias("_last"))
    same = F.col("block") == F.col("_b")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    sides = rows.join(F.broadcast(last) if not group else last, same)
    left = F.when(F.col("idx") > F.col("_last") - border, F.struct(F.col("block").alias("border"), F.lit(0).alias("side")))
    right = F.when((F.col("idx") < F.col("block") * block + border) & (F.col("block") > 0), F.struct((F.col("block") - 1).alias("border"), F.lit(1).alias("side")))
    sides = sides.select(*group, "idx", vector, F.explode(F.array_compact(F.array(left, right))).alias("_s")).select(*group, "idx", vector, "_s.border", "_s.side")
    names = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        tail, head = (pdf[pdf.side == k] for k in (0, 1))
        if not len(tail) or not len(head):  # the last block has no border on its right
            return pd.DataFrame(columns=[*group, "border", "tested_pairs", "high_pairs", "left_involved", "right_involved"])
        counts = border_counts(unit_rows(tail[vector].tolist()), unit_rows(head[vector].tolist()), threshold)
        out = pd.DataFrame([(int(pdf.border.iloc[0]), *counts)], columns=["border", "tested_pairs", "high_pairs", "left_involved", "right_involved"])
        for g in reversed(group):
            out.insert(0, g, pdf[g].iloc[0])
        return out

    borders = sides.groupBy(*group, "border").applyInPandas(across, f"{names}{', ' if names else ''}border long, {BORDER_SCHEMA}")
    return found, borders


class OrderError(ValueError):
    pass


class _Blocks:
    """Rows of one group that came in about the right order: the open block, the rows of the next one, and the last tail."""

    def __init__(self, n: int, block: int, border: int, threshold: float) -> None:
        self.n, self.block, self.border, self.threshold = n, block, border, threshold
        self.start, self.rows, self.tail, self.filled = 0, {}, None, 0

    def push(self, idx: int, key, vector) -> Iterator[tuple]:
        """Takes a row; gives the rows of blocks that it completes and of their borders."""
        if not self.start <= idx < min(self.start + 2 * self.block, self.n):
            raise OrderError(f"row {idx} came while block {self.start // self.block} was open")
        if idx in self.rows:
            raise OrderError(f"row {idx} came twice")
        self.rows[idx] = (key, unit_rows([vector])[0])
        self.filled += idx < self._stop()
        while self.start < self.n and self.filled == self._stop() - self.start:
            yield from self._finish()

    def _stop(self) -> int:
        return min(self.start + self.block, self.n)

    def _finish(self) -> Iterator[tuple]:
        stop, number = self._stop(), self.start // self.block
        own = [self.rows.pop(k) for k in range(self.start, stop)]
        x = np.array([v for _, v in own])
        for k, team in enumerate(block_teams(x, self.threshold)):
            yield ("team", own[k][0], self.start + k, number, self.start + team, None, None, None, None)
        if self.tail is not None:
            yield ("border", None, None, number - 1, None, *border_counts(self.tail, x[: self.border], self.threshold))
        self.tail, self.start = x[-self.border :].copy(), stop
        self.filled = sum(1 for k in self.rows if k < self._stop())


def stream_linkage(stream: DataFrame, group: str, key: str, idx: str, size: str, vector: str, threshold: float = 0.8, block: int = BLOCK, border: int = BORDER) -> DataFrame:
    """:func:`blocked_linkage` of a stream of rows that know their place ``idx`` (from 0) and their group's ``size``.

    Rows may run ahead by one block at most: the state of a group is the open block, the
    rows of the next, and the tail of the last, never more.  A block's teams and the border
    before it come out when its last row has come.  A row of a finished block, of a block
    beyond the next, or one that came before fails the query.  Rows of the result have
    ``kind`` ``team`` (key, idx, block, team) or ``border`` (block on its left, counts).
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (group, key)}
    columns = [group, "kind", key, "idx", "block", "team", "tested_pairs", "high_pairs", "left_involved", "right_involved"]
    schema = f"`{group}` {kinds[group]}, kind string, `{key}` {kinds[key]}, idx long, block long, team long, {BORDER_SCHEMA}"

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        for pdf in frames:
            out = []
            for place, n, k, v in zip(pdf[idx].tolist(), pdf[size].tolist(), pdf[key].tolist(), pdf[vector].tolist()):
                held = held or _Blocks(int(n), block, border, threshold)
                out += [(keys[0], *row) for row in held.push(int(place), k, v)]
            if out:
                yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in columns[3:]})
        if held is not None:
            state.update((pickle.dumps(held),))

    return stream.select(group, key, idx, size, vector).groupBy(group).applyInPandasWithState(step, schema, "held binary", "append", "NoTimeout")


# --- agglomeration ------------------------------------------------------------------------


def ward_merges(x: np.ndarray, weight: np.ndarray) -> list[tuple[float, int, int]]:
    """``(height, i, j)`` of all merges by a chain of nearest neighbours; memory is that of the rows, no matrix of pairs.

    Inner products choose the rows that may be nearest, and only their distances are taken
    exactly; rows that were merged away are dropped once they are half of all.
    """
    centre, mass, alive, ids = x.copy(), weight.astype(float).copy(), np.ones(len(x), bool), np.arange(len(x))
    norm = (centre**2).sum(1)
    merges, chain = [], []
    for left in range(len(x), 1, -1):
        if 2 * left <= len(ids):
            place = np.cumsum(alive) - 1
            chain = [int(place[i]) for i in chain]
            centre, mass, norm, ids, alive = centre[alive], mass[alive], norm[alive], ids[alive], alive[alive]
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            top = chain[-1]
            scale = mass * mass[top] / (mass + mass[top])
            rough = (norm - 2 * (centre @ centre[top]) + norm[top]) * scale
            rough[~alive] = np.inf
            rough[top] = np.inf
            slack = 1e-12 * (norm + norm[top]) * scale
            may = rough - slack <= (rough + slack).min()
            if len(chain) > 1:
                may[chain[-2]] = True
            may = np.flatnonzero(may & alive)
            d = ((centre[may] - centre[top]) ** 2).sum(1) * scale[may]
            d[may == top] = np.inf
            near, height = int(may[d.argmin()]), float(d.min())
            if len(chain) > 1 and d[np.searchsorted(may, chain[-2])] <= height:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((height, int(ids[a]), int(ids[b])))
        total = mass[a] + mass[b]
        centre[a] = (mass[a] * centre[a] + mass[b] * centre[b]) / total
        norm[a] = (centre[a] ** 2).sum()
        mass[a], alive[b] = total, False
    return merges


def cut_merges(n: int, merges: list[tuple[float, int, int]], k: int) -> list[int]:
    """Cluster numbers (by least row) after the lowest ``n - k`` merges."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - k)]:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    names = {t: c for c, t in enumerate(dict.fromkeys(map(find, range(n))))}
    return [names[find(i)] for i in range(n)]


def ward(df: DataFrame, group: list[str], key: str, vector: str, k: int, weight: str | None = None) -> DataFrame:
    """``group, key, cluster``: Ward's clusters of each group.

    A group is one task with memory for its rows.  For groups beyond that, cluster the
    centres of a coarser clustering with their sizes as ``weight``: Ward's criterion depends
    on centres and sizes alone.
    """
    columns = list(dict.fromkeys([*group, key, vector, *([weight] if weight else [])]))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*group, key]) + ", cluster long"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.array(pdf[vector].tolist(), float)
        mass = pdf[weight].to_numpy(float) if weight else np.ones(len(x))
        return pdf[[*group, key]].assign(cluster=cut_merges(len(x), ward_merges(x, mass), k))

    return df.select(*columns).groupBy(*group).applyInPandas(step, schema)


# --- spectral -----------------------------------------------------------------------------


def spectral_embedding(edges: DataFrame, k: int, rounds: int = 40, seed: str = "") -> DataFrame:
    """``node, e0 .. e{k-1}``: leading eigenvectors of the normalised adjacency of an undirected graph (``a, b, w``).

    Block power iteration: a round is one join of the edges with the vectors and one sum by
    node, then the vectors are made orthonormal by the k x k matrix of their products, all
    that the driver sees.  Eigenvalues are shifted to 0 .. 1, so the leading ones are the
    algebraically largest.  The first vector is known (roots of the degrees) but kept, so
    components of the graph come out as such.
    """
    both = edges.select("a", "b", F.col("w").cast("double").alias("w")).where("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    degree = both.groupBy("a").agg(F.sum("w").alias("d"))
    scaled = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    links = settle(scaled.select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("db"))).alias("w")))
    names = [f"e{i}" for i in range(k)]
    draws = [(F.pmod(F.xxhash64(F.lit(f"{seed}{i}"), F.col("node")), F.lit(2**31)) / 2.0**31 - 0.5).alias(f"e{i}") for i in range(k)]
    x = settle(links.select(F.col("a").alias("node")).distinct().select("node", *draws))
    for _ in range(rounds):
        moved = links.join(x.withColumnRenamed("node", "b"), "b").groupBy("a").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"_{c}") for c in names])
        y = settle(x.join(moved, x["node"] == moved["a"]).select("node", *[((F.col(c) + F.col(f"_{c}")) / 2).alias(c) for c in names]))
        products = y.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]).first()
        gram = np.array([[products[f"p{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
        lam, vec = np.linalg.eigh(gram)
        turn = (vec / np.sqrt(np.maximum(lam, 1e-300)))[:, ::-1]  # columns by decreasing weight, orthonormal afterwards
        x = y.select("node", *[sum((F.col(names[i]) * float(turn[i, j]) for i in range(k)), F.lit(0.0)).alias(names[j]) for j in range(k)])
    return settle(x)


def spectral(edges: DataFrame, k: int, rounds: int = 40, seed: int = 1) -> DataFrame:
    """``node, cluster``: k-means of the row-normalised spectral embedding."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = spectral_embedding(edges, k, rounds)
    norm = F.sqrt(sum((F.col(f"e{i}") * F.col(f"e{i}") for i in range(k)), F.lit(0.0)))
    rows = x.select("node", array_to_vector(F.array(*[F.col(f"e{i}") / F.greatest(norm, F.lit(1e-300)) for i in range(k)])).alias("features"))
    model = KMeans(k=k, seed=seed, initSteps=5, maxIter=50, predictionCol="cluster").fit(rows)
    return model.transform(rows).select("node", F.col("cluster").cast("long").alias("cluster"))


# --- consensus ----------------------------------------------------------------------------


def co_association(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, n_both, n_same, share`` of given pairs (neighbours, say) over ``runs`` (``run, id, cluster``; noise is -1).

    Only the given pairs are counted, each once a run that drew both.
    """
    left = runs.select("run", F.col("id").alias("a"), F.col("cluster").alias("_ca"))
    right = runs.select("run", F.col("id").alias("b"), F.col("cluster").alias("_cb"))
    together = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "run"])
    same = (F.col("_ca") == F.col("_cb")) & (F.col("_ca") >= 0)
    return together.groupBy("a", "b").agg(F.count("*").alias("n_both"), F.count_if(same).alias("n_same")).withColumn("share", F.col("n_same") / F.col("n_both"))


def consensus(shares: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``node, cluster`` (least node): average linkage on 1 - share, cut where the mean share falls below ``threshold``.

    Pairs that are not given have share 0, so parts of the graph of positive shares never
    merge; each part is one task.
    """
    linked = shares.where("share > 0 AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "share").distinct()
    parts = components(linked, "a", "b")
    kind = shares.schema["a"].dataType.simpleString()

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*pdf.a, *pdf.b})
        at = {v: i for i, v in enumerate(ids)}
        share, size, team = np.zeros((len(ids), len(ids))), np.ones(len(ids)), np.arange(len(ids))
        i, j = pdf.a.map(at).to_numpy(), pdf.b.map(at).to_numpy()
        share[i, j] = share[j, i] = pdf.share
        while True:
            a, b = sorted(divmod(int(share.argmax()), len(ids)))
            if a == b or share[a, b] < threshold - 1e-9:
                break
            share[a] = share[:, a] = (share[a] * size[a] + share[b] * size[b]) / (size[a] + size[b])
            share[b] = share[:, b] = share[a, a] = 0.0
            size[a] += size[b]
            team[team == b] = a
        return pd.DataFrame({"node": ids, "cluster": [ids[t] for t in team]})

    tagged = linked.join(parts, F.col("a") == F.col("node")).select("component", "a", "b", "share")
    merged = tagged.groupBy("component").applyInPandas(step, f"node {kind}, cluster {kind}")
    alone = shares.select("a").union(shares.select("b")).distinct().select(F.col("a").alias("node")).join(parts, "node", "left_anti")
    return merged.unionByName(alone.select("node", F.col("node").alias("cluster")))

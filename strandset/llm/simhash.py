"""SimHash fingerprints and their near-duplicate classes by a binary trie self-join.

A trie's self-join walks pairs of nodes of equal depth together, from the pair (root,
root): it adds up the bits in which the two prefixes differ and drops a pair beyond the
budget.  With a budget of ``b`` differing bits there are ``b + 1`` tries, each over the
fingerprints with another third (for two bits) of their bits in front: of two linked
fingerprints at least one such part is equal, so in one trie both are below one node at
that depth, and the walk of each trie begins at the pairs (node, node) there.  The nodes
are dealt to Spark's tasks by their prefix; pairs of nodes that hold more than
``leaf_rows`` fingerprints are walked on, ``STEP`` bits at a time, by DataFrame functions
until they are small, so no task holds a node of unbounded size.  In a task the walk goes
on over sorted arrays, where a node is a range, all node pairs of a level at once.  A task
keeps only a spanning forest of its links, so a class of any size gives fewer links than
copies.  Classes come from alternating large-star and small-star steps over the links; what
meets a node of very many links is sent to it by broadcast of at most a thousand rows.

Defined results: null text counts as empty, and a text without words has fingerprint zero,
linked like any other; equal rows share a class; an empty table gives no rows; rows with a
null ``doc_id`` get a fingerprint but do not name a class unless all its ids are null;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_name, materialize, parts

SHINGLE = 3
BUDGET = 2
BITS = 64
LEAF_ROWS = 16_384
STEP = 6
#: At most so many node pairs are too large for a task at a time (larger tables have larger tasks).
MOST_LARGE = 100_000


def fingerprint_of(raw: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a lower-cased UTF-8 text."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    text = b" ".join(words)
    if len(words) <= shingle:
        pieces = [text]
    else:
        pieces = [text[a:b] for a, b in zip(starts[: -(shingle - 1)].tolist(), ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, 42) for p in pieces), np.uint64, len(pieces))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` columns ``doc_id`` and ``fp`` (the fingerprint as a signed 64-bit integer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fps = [fingerprint_of((t or "").encode("utf-8", "replace"), shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


# --- walking the trie ------------------------------------------------------------------


def trie_links(values: np.ndarray, roots: np.ndarray, budget: int = BUDGET, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Indices ``i < j`` of ``values`` (uint64) that differ in at most ``budget`` bits.

    ``roots`` holds node pairs ``lo, hi, lo, hi``: ranges of ``values`` that are sorted in
    themselves; a range paired with itself gives the links inside it.  Node pairs are walked
    level by level, all pairs of a level at once; pairs of nodes with few fingerprints are
    compared one by one.
    """
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    nodes = np.column_stack([roots, np.zeros(len(roots), np.int64)]).astype(np.int64)
    for bit in range(BITS - 1, -2, -1):
        few = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= small
        if bit < 0:
            few[:] = True
        for i, j in _compare(nodes[few], values, budget):
            found_i.append(i)
            found_j.append(j)
        nodes = nodes[~few]
        if not len(nodes):
            break
        ones = np.concatenate(([0], np.cumsum((values & np.uint64(1 << bit)) != 0)))
        lo_l, hi_l, lo_r, hi_r, diff = nodes.T
        mid_l, mid_r = hi_l - (ones[hi_l] - ones[lo_l]), hi_r - (ones[hi_r] - ones[lo_r])
        crossed = np.stack([mid_l, hi_l, lo_r, mid_r, diff + 1], 1)
        crossed = crossed[(lo_l != lo_r) | (hi_l != hi_r)]  # a node with itself: its two crossed pairs are one
        nodes = np.concatenate([np.stack(c, 1) for c in ((lo_l, mid_l, lo_r, mid_r, diff), (mid_l, hi_l, mid_r, hi_r, diff), (lo_l, mid_l, mid_r, hi_r, diff + 1))] + [crossed])
        nodes = nodes[(nodes[:, 4] <= budget) & (nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2])]
    return np.concatenate(found_i), np.concatenate(found_j)


def _compare(nodes: np.ndarray, values: np.ndarray, budget: int, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
    at = 0
    while at < len(nodes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + chunk]), chunk, side="right")))
        part, size = nodes[at : at + n], sizes[at : at + n]
        at += n
        which = np.repeat(np.arange(len(part)), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        width = (part[:, 3] - part[:, 2])[which]
        i, j = part[which, 0] + k // width, part[which, 2] + k % width
        near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        yield i[near], j[near]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least node of its class: the classes of one task's links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return label[at], at


def _rotated(bits: int) -> Column:
    return F.col("fp") if not bits else F.shiftleft("fp", bits).bitwiseOR(F.shiftrightunsigned("fp", BITS - bits))


def node_pairs(distinct: DataFrame, budget: int = BUDGET, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``trie, a, b, side, v``: the fingerprints ``v`` (bits turned as in the trie) of every node
    pair ``(a, b)`` left to walk; ``side`` tells which of the two nodes holds ``v``."""
    tries = budget + 1  # one bit of budget at least: equal fingerprints are one row
    cuts = [k * BITS // tries for k in range(tries + 1)]
    turned = F.array(*[F.struct(F.lit(k).alias("trie"), _rotated(cuts[k]).alias("v"), F.lit(cuts[k + 1] - cuts[k]).alias("depth")) for k in range(tries)])
    rows = distinct.select(F.explode(turned).alias("t")).select("t.*")
    node = F.expr(f"shiftrightunsigned(v, {BITS} - depth)")
    rows = rows.select("trie", "depth", node.alias("a"), node.alias("b"), F.lit(0).alias("side"), "v")
    key = ["trie", "depth", "a", "b"]
    masks = F.array(*[F.lit(m) for m in range(1 << STEP) if m.bit_count() <= budget])
    total, done = None, []
    while True:
        held = rows.groupBy(*key).agg(F.count("*").alias("n"))
        if total is None:
            total = distinct.count() * tries
        large = held.where(F.col("n") > max(2 * leaf_rows, total // MOST_LARGE)).where(F.col("depth") < BITS).select(*key)
        large = materialize(large, "large")  # at most MOST_LARGE rows
        if large.isEmpty():
            break
        done.append(rows.join(F.broadcast(large), key, "left_anti"))
        # each fingerprint of a large pair goes to the pairs of its child with the near children of the other node
        deeper = F.least(F.col("depth") + STEP, F.lit(BITS))
        child = F.expr(f"shiftrightunsigned(v, {BITS} - deeper)")
        other = F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
        split = rows.join(F.broadcast(large), key).withColumn("deeper", deeper).withColumn("child", child)
        split = split.withColumn("mask", F.explode(masks)).withColumn("step", F.col("deeper") - F.col("depth")).where("mask < shiftleft(1, step)")
        split = split.withColumn("o", other).withColumn("other", F.expr("shiftleft(o, step) | ((child & (shiftleft(1L, step) - 1L)) ^ mask)"))
        split = split.where(F.expr(f"bit_count(child ^ other) <= {budget}"))
        first = F.when(F.col("a") == F.col("b"), F.col("child") <= F.col("other")).otherwise(F.col("side") == 0)
        rows = split.select("trie", F.col("deeper").alias("depth"), F.when(first, F.col("child")).otherwise(F.col("other")).alias("a"), F.when(first, 0).otherwise(1).alias("side"), "v", F.when(first, F.col("other")).otherwise(F.col("child")).alias("b"))
        rows = materialize(rows, "nodes")
    out = rows
    for part in done:
        out = out.unionByName(part)
    return out.select("trie", "depth", "a", "b", "side", "v")


def near_links(distinct: DataFrame, budget: int = BUDGET, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp``, enough to join each class."""
    tries = budget + 1
    cuts = np.array([k * BITS // tries for k in range(tries)], np.uint64)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            cols = None if batch is None else [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
            if rest is not None:
                cols = rest if cols is None else [np.concatenate(p) for p in zip(rest, cols)]
            if cols is None:
                return
            n = len(cols[0])
            new = np.ones(n, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
            begin = np.flatnonzero(new)
            if batch is not None:  # the last node pair may go on in the next batch
                rest = [c[begin[-1] :].copy() for c in cols] if n else cols
                cols, begin = [c[: begin[-1]] for c in cols] if n else cols, begin[:-1]
            end = np.append(begin[1:], len(cols[0])) if len(begin) else begin
            begin, end = begin[end - begin > 1], end[end - begin > 1]
            if not len(begin):
                continue
            v = cols[5].view(np.uint64)
            right = np.concatenate(([0], np.cumsum(cols[4] != 0)))
            middle = end - (right[end] - right[begin])
            own = cols[2][begin] == cols[3][begin]
            roots = np.stack([begin, np.where(own, end, middle), np.where(own, begin, middle), end], 1)
            i, j = trie_links(v, roots[(roots[:, 1] > roots[:, 0]) & (roots[:, 3] > roots[:, 2])], budget)
            turn = cuts[cols[0]]
            back = (v >> turn) | np.where(turn > 0, v << ((np.uint64(BITS) - turn) & np.uint64(BITS - 1)), np.uint64(0))
            a, b = spanning(i, j, len(v))
            yield pa.RecordBatch.from_arrays([pa.array(back[a].view(np.int64)), pa.array(back[b].view(np.int64))], ["a", "b"])

    key = ["trie", "depth", "a", "b"]
    pairs = node_pairs(distinct.select("fp"), budget, leaf_rows)
    # within a side the trie's order is that of unsigned numbers
    dealt = pairs.repartition(*key).sortWithinPartitions(*key, "side", (F.col("v") < 0), "v")
    return dealt.mapInArrow(walk, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with the least ``v`` of each ``u`` as ``m``.

    Nodes with more than a 500th of the rows are few; they go by broadcast, so no task gets all rows of one.
    """
    least = materialize(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    limit = max(64, total // 500)
    if least.where(F.col("n") > limit).isEmpty():
        return rows.join(least.drop("n"), "u")
    heavy = F.broadcast(least.where(F.col("n") > limit).drop("n"))  # at most 1,000 rows
    rest = rows.join(heavy.select("u"), "u", "left_anti").join(least.where(F.col("n") <= limit).drop("n"), "u")
    return rows.join(heavy, "u").unionByName(rest)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b): alternating large- and small-star steps."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    print_of = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).alias("s")
    stats = edges.agg(print_of).first().s
    for _ in range(max_rounds):
        # large star: the larger neighbours of a node go to its least neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * stats.n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = materialize(large.distinct(), "large")
        # small star: the smaller neighbours of a node, and itself, go to the least of them
        moved = _with_least(large, stats.n)
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.where("v = m").select("u", "v"))
        new = materialize(small.where("u <> v").distinct(), "links")
        before, stats = stats, new.agg(print_of).first().s
        discard(edges, large)
        edges = new
        if before == stats:
            break
    else:
        raise RuntimeError("classes did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` (least ``doc_id`` of the class) for every document."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    by_fp = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(by_fp.select("fp"), budget))
    rooted = by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return classes(docs).select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that name their class; of rows that share an id, those stay together.

    A class is joined by the links of fingerprints, and by those of five-word shingle sets of Jaccard similarity 0.8 or more.
    """
    from .nearset import near_classes

    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = near_classes(docs).groupBy("doc_id").agg(F.max(kept).alias("kept")).where("NOT kept")
    id_ = fresh_name(docs, "id")
    gone = materialize(gone.select(F.col("doc_id").alias(id_)), "gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)), "left_anti")

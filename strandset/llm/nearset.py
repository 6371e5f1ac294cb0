"""Near-duplicate classes by SimHash fingerprints and by exact Jaccard similarity of word-shingle sets.

The classes of the fingerprints (:mod:`.simhash`: trie self-join with a Hamming budget) are the
first links.  Two bits miss most copies of a few changed words, so two texts are linked as well
when the sets of their five-word shingles (64-bit hashes) have Jaccard
similarity 0.8 or more.  Candidates come from the prefix filter, which loses no pair: under
one order of all shingles, two such sets share a shingle among the first
``n - ceil(0.8 n) + 1`` of each.  The order puts rare shingles first.  How common they are is
estimated on a sample of texts; that decides only how many candidates there are, never
which pairs are found.  A bitmap of each set (the parity of its hashes by their low bits)
bounds what two sets can share: they differ in at least as many elements as their bitmaps
in bits.  For the pairs that this leaves, Jaccard similarity is computed from the whole
sets, made again from these texts; sets are never stored for all texts.

A large group of near copies would give all its pairs.  So each shared shingle first gives
only a star, one of its sets with each of the others: the centre is the set with the least
share of prefix shingles that no other set has, which of an original and its changed copies
is the original.  Each set is compared with the one
centre that it shares most with; what the links leave in different classes is compared with
the other centres; and after that pairs of a shingle that still lie in different classes, if
enough of their prefixes is shared.  The entries of a shingle that the sample shows to be common are
dealt to several tasks.  A centre's text and those to compare with it meet in one task, or in
several if they are many, the centre first, so each text travels once and a task holds one set.

Defined results: null text counts as empty; texts without words are equal; a text of fewer
than five words is one shingle; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, parts
from .simhash import _with_least, components, fingerprint_of, near_links

SHINGLE = 5
#: Texts whose shingles are counted for the order, and the most shingles it ranks.
ORDER_TEXTS = 4_000
ORDER_SHINGLES = 200_000
#: A shingle of so many of the sample's texts is common, and is dealt to so many tasks.
COMMON_TEXTS = 8
DEALS = 32
#: Texts that meet a centre in one task.
MEMBERS = 1000


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a lower-cased text."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    joined = b" ".join(words)
    if len(words) <= shingle:
        pieces = [joined]
    else:
        pieces = [joined[a:b] for a, b in zip(starts[: -(shingle - 1)].tolist(), ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p, 42) for p in pieces), np.uint64, len(pieces)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have Jaccard similarity 0.8 or more."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 9 * both >= 4 * (len(a) + len(b))


def bitmap(x: np.ndarray) -> bytes:
    """Parities of a set's hashes by their low bits; two to four bits an element."""
    bits = 64
    while bits < 2 * len(x):
        bits *= 2
    return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def folded(x: np.ndarray) -> list[int]:
    """Parities of a set's hashes by their low eight bits, as four 64-bit numbers: a bound that a join can test."""
    return np.packbits((np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(bool)).view(np.int64).tolist()


def may_be_similar(a: bytes, b: bytes, size: int) -> bool:
    """Whether bitmaps leave two sets of ``size`` elements together a similarity of 0.8."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    differ = int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())
    return 9 * differ <= size


def common_shingles(docs: DataFrame, texts: int = ORDER_TEXTS, most: int = ORDER_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles of several texts of a sample, and in how many of them they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    share = max(1, docs.count() // texts)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    counted = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    rows = counted.orderBy(F.desc("n"), "h").limit(most).collect()
    h, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix_size(n: int) -> int:
    """How many of a set's first shingles any similar set shares one of."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def prefixes_of(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, text_hash, fp, key, size, rare, prefix, bits, fold``: each text's SimHash, hash and size of its set, its first shingles, how many of these are not common, its bitmap, and that in 256 bits."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, often = shared.value
        for batch in parts(batches):
            fps, keys, sizes, rares, prefixes, bits, folds = [], [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                fps.append(fingerprint_of((text or "").encode("utf-8", "replace")))
                x = shingle_set(text)
                rank = np.zeros(len(x), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    rank = np.where(known[at] == x, often[at], 0)
                first = np.lexsort((x, rank))[: prefix_size(len(x))]
                keys.append(xxhash.xxh64_intdigest(x.tobytes(), 7))
                sizes.append(len(x))
                rares.append(int((rank[first] < COMMON_TEXTS).sum()))
                prefixes.append(x[first].view(np.int64))
                bits.append(bitmap(x))
                folds.append(folded(x))
            cols = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(rares, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(folds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "fp", "key", "size", "rare", "prefix", "bits", "fold"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, fp long, key long, size int, rare int, prefix array<long>, bits binary, fold array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def verified(pairs: DataFrame, docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of keys whose sets have Jaccard similarity 0.8 or more."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2000):
            a, b, size = (batch.column(c).to_pylist() for c in (2, 3, 4))
            yield batch.select(["a", "b"]).filter(pa.array(map(may_be_similar, a, b, size), pa.bool_()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in parts(batches):
            left, right = [], []
            for a, member, b, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                x = shingle_set(text)
                if not member:
                    centre, own = a, x
                elif centre == a and similar(own, x):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    bits = prefixes.select("key", "size", "bits").dropDuplicates(["key"])
    left = bits.select(F.col("key").alias("a"), F.col("size").alias("n"), F.col("bits").alias("x"))
    right = bits.select(F.col("key").alias("b"), F.col("size").alias("m"), F.col("bits").alias("y"))
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", (F.col("n") + F.col("m")).alias("size"))
    pairs = materialize(pairs.mapInArrow(possible, "a long, b long"), "possible")
    dealt = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(MEMBERS))).cast("int").alias("deals"))
    members = pairs.join(dealt, "a").select("a", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("part"), F.lit(True).alias("member"), F.col("b").alias("key"))
    wanted = members.unionByName(dealt.select("a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("part"), F.lit(False).alias("member"), F.col("a").alias("key")))
    # one text of each set that is needed; Spark picks the joins by the sizes of these tables
    used = materialize(wanted.select("key").distinct(), "used")
    chosen = materialize(prefixes.select("key", "doc_id", "text_hash").join(used, "key").groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "text_hash")).alias("t")).select("key", F.col("t.doc_id").alias("_id"), F.col("t.text_hash").alias("_hash")), "chosen")
    wanted = materialize(wanted.join(chosen, "key").select("a", "part", "member", "key", "_id", "_hash"), "wanted")
    texts = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), "text")
    met = texts.join(wanted, F.col("_d").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_hash"))).select("a", "member", "key", "text", "part")
    return met.repartition("a", "part").sortWithinPartitions("a", "part", "member").mapInArrow(near, "a long, b long").distinct()


def _fits(a: str, b: str) -> str:
    """The shingles from the shared one on can still make up the similarity."""
    return f"9 * least({a}.size - {a}.pos, {b}.size - {b}.pos) >= 4 * ({a}.size + {b}.size)"


def set_links(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Verified links ``a, b`` between distinct keys, enough to join each class."""
    entries = prefixes.select("key", "size", "rare", F.posexplode("prefix").alias("pos", "h"))
    deal = F.when(F.col("pos") < F.col("rare"), 0).otherwise(1 + F.pmod(F.xxhash64("key"), F.lit(DEALS))).cast("int")
    own = Window.partitionBy("h", "deal")
    entries = entries.select("h", deal.alias("deal"), "key", "size", "pos").withColumn("least", F.min("key").over(own)).withColumn("most", F.max("key").over(own))
    met = materialize(entries.where("deal > 0 OR least <> most").drop("least", "most").distinct(), "met")
    alone = (1000 * (1 - F.count("*") / F.greatest(F.max(_prefix("size")), F.lit(1)))).cast("int").alias("alone")
    central = met.join(met.groupBy("key").agg(alone), "key")
    centres = central.groupBy("h", "deal").agg(F.min(F.struct("alone", "key", "size", "pos")).alias("p"))
    centres = centres.select("h", "deal", F.min("p").over(Window.partitionBy("h")).alias("p"))  # at most DEALS + 1 rows a shingle
    live = materialize(met.join(centres, ["h", "deal"]), "shared")
    star = live.alias("e").where("e.key <> e.p.key").groupBy(F.col("e.key").alias("b"), F.col("e.p.key").alias("a")).agg(F.count("*").alias("n"), F.max(F.expr(_fits("e", "e.p"))).alias("fits")).where("fits")
    star = materialize(star.select("a", "b", "n"), "pairs")
    best = star.groupBy("b").agg(F.max(F.struct("n", F.col("a"))).alias("m")).select("m.a", "b")
    links = materialize(verified(best, docs, prefixes), "links")
    # what lies in one class already needs no comparison
    roots = components(links)
    other = star.select("a", "b").join(best, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        other = other.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    other = materialize(other.where("root_a <> root_b").select("a", "b"), "pairs")
    links = materialize(links.unionByName(verified(other, docs, prefixes)), "links")
    roots = components(links)
    named = live.select("h", "key", "size", "pos").distinct().join(roots, F.col("key") == F.col("node"), "left").select("h", "key", "size", "pos", F.coalesce("root", "key").alias("root"))
    named = materialize(named, "named")
    open_ = named.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    folds = prefixes.select("key", *[F.get("fold", F.lit(k)).alias(f"w{k}") for k in range(4)]).dropDuplicates(["key"])
    left = materialize(named.join(open_, "h", "left_semi").join(folds, "key"), "open")
    # the bound of the bitmaps stands in the join, so pairs that it refuses are not made
    differ = " + ".join(f"bit_count(x.w{k} ^ y.w{k})" for k in range(4))
    both = left.alias("x").join(left.alias("y"), F.expr(f"x.h = y.h AND x.key < y.key AND x.root <> y.root AND 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size) AND 9 * ({differ}) <= x.size + y.size"))
    # of the two prefixes one ends first in the order; what else is shared lies behind it
    rest = both.groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.size").alias("xs"), F.col("y.size").alias("ys")).agg(F.count("*").alias("n"), F.max(F.expr(_fits("x", "y"))).alias("fits"))
    beyond = F.greatest(F.col("xs") - _prefix("xs"), F.col("ys") - _prefix("ys"))
    rest = rest.where("fits").where(9 * (F.col("n") + beyond) >= 4 * (F.col("xs") + F.col("ys"))).select("a", "b")
    rest = materialize(rest.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    out = materialize(links.unionByName(verified(rest, docs, prefixes)), "links")
    discard(met, live, named, left, star, other, rest, links)
    return out


def _prefix(size: str) -> Column:
    return F.col(size) - F.floor((4 * F.col(size) + 4) / 5) + 1


def simhash_links(prefixes: DataFrame) -> DataFrame:
    """Links ``a, b`` of keys: the least key of each class of fingerprints with its others."""
    both = materialize(prefixes.select("fp", "key").distinct(), "fingerprints")
    roots = components(near_links(both.select("fp").distinct()))
    rooted = both.join(roots, both.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("u"), F.col("key").alias("v"))
    rooted = materialize(rooted.distinct(), "rooted")
    return _with_least(rooted, rooted.count()).where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` (least ``doc_id`` of the class) for every document."""
    """``doc_id, component_id`` (least ``doc_id`` of the class) for every document."""
    return classes_of(docs, common_shingles(docs))


def classes_of(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    prefixes = materialize(prefixes_of(docs, common), "prefixes")
    by_key = materialize(prefixes.groupBy("key").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(simhash_links(prefixes).unionByName(set_links(docs, prefixes)))
    rooted = by_key.join(roots, by_key.key == roots.node, "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("key", "component_id")
    return prefixes.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")

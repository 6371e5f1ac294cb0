"""SimHash classes against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strandset.llm import simhash


def plain_fingerprint(text):
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = [w for w in low.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows, budget=2):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(fps)}


def corpus():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(60)]
    texts = [None, "", " \n\t", "One", "one", "one two", "Été ONE", "x" * 5000, "a b " * 3000]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append("  ".join(base))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, fp string").repartition(6)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == plain_classes(rows)


def test_fingerprint_is_sparks_xxhash64(spark):
    one = spark.sql("select xxhash64('one') h").first().h & (1 << 64) - 1
    assert simhash.fingerprint_of(b"ONE") == one


def near_values(seed, n, centres):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    near = base[rng.integers(0, centres, n)] ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(np.concatenate([base, near]))


def all_links(x, budget=2):
    return {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if int(x[a] ^ x[b]).bit_count() <= budget}


def test_trie_links_equal_all_pairs():
    x = near_values(2, 400, 40)
    i, j = simhash.trie_links(x, np.array([[0, len(x), 0, len(x)]]), 2, small=4)
    assert set(zip(i.tolist(), j.tolist())) == all_links(x)
    both = np.concatenate([x[::2], x[1::2]])  # two nodes side by side
    m = len(x[::2])
    i, j = simhash.trie_links(both, np.array([[0, m, m, len(both)]]), 2, small=1)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in all_links(both) if a < m <= b}


def joined(links, values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_near_links_equal_all_pairs_at_every_node_size(spark):
    x = near_values(3, 300, 12)
    x = np.unique(np.concatenate([x, x & np.uint64((1 << 20) - 1)]))  # many share their first bits
    values = x.view(np.int64).tolist()
    want = joined([(values[a], values[b]) for a, b in all_links(x)], values)
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(4)
    for rows in (16_384, 12):
        got = [(r.a, r.b) for r in simhash.near_links(df, leaf_rows=rows).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in got) and joined(got, values) == want
    assert simhash.near_links(df.limit(0)).count() == 0


def test_large_node_pairs_are_split(spark):
    x = (near_values(5, 200, 3) & np.uint64((1 << 40) - 1)).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in sorted(set(x))], "fp long")
    pairs = simhash.node_pairs(df, leaf_rows=8).groupBy("trie", "depth", "a", "b").count().agg(F.max("count"), F.max("depth")).first()
    assert pairs[0] <= 16 and pairs[1] > 22


def test_hub_is_one_class(spark):
    links = spark.range(1, 3000).selectExpr("id AS a", "IF(id % 2 = 0, 0, 5000) AS b").union(spark.sql("SELECT 5000L, 4L"))
    assert simhash.components(links).groupBy("root").count().collect() == [(0, 3000)]


def test_chain_is_one_class(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100}


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(5, "a b c d"), (2, "a b c d"), (9, None), (8, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [2, 8]
    assert simhash.near_duplicates(df.where("doc_id > 99")).count() == 0
    dup = df.union(df).withColumn("text", F.col("text"))
    assert simhash.near_duplicates(dup).count() == 8
    nulls = spark.createDataFrame([(None, "a"), (4, "a")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(nulls).collect()} == {(None, 4), (4, 4)}

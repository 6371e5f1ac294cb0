"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from strandset.llm import queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, k):
    """All scores, then the k best; ``docs`` are (doc_id, text), ``items`` (item_id, text)."""
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * f + 1))) for t, f in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // total
            scored.append((sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c), d))
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:k]
        out += [(i, r + 1, d, s) for r, (s, d) in enumerate(best)]
    return sorted(out, key=repr)


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "in"], [f"w{i}" for i in range(120)]

    def text():
        return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare[: rng.choice([10, 40, 120])]) for _ in range(rng.choice([3, 20, 80, 300])))

    docs = [(i * 2, text()) for i in range(n)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties of a large group of copies
    docs += [(None, "the w1 w2"), (None, "the w1 w2"), (7, None), (9, ""), (11, " ,.-"), (13, "É é W1-w2_W3 日本 x"), (15, "w3 " * 40_000), (2, docs[0][1])]
    items = [(i, text()) for i in range(25)] + [(30, None), (31, ""), (32, "unheard"), (33, "É 日本"), (None, "w1 w2"), (34, "the"), (34, "w9"), (35, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("k, block", [(10, 250_000), (1, 60), (500, 250_000)])
def test_equals_scoring_all(spark, monkeypatch, k, block):
    monkeypatch.setattr(ranked, "PIECE_BYTES", 1000)
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, n int").repartition(5)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in ranked.search(d, q, k, block).collect()), key=repr)
    assert got == plain(docs, items, k)


def test_pruning_leaves_terms_out(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = ranked.item_terms(spark.createDataFrame(items, "item_id long, text string")).where("item_id is not null")
    terms = sorted(r.term for r in pairs.select("term").distinct().collect())
    indexed = ranked.index(d, {t.encode(): k for k, t in enumerate(terms)}).cache()
    n_docs, total = len([1 for _, t in docs if words(t)]), sum(len(words(t)) for _, t in docs)
    numbered = spark.createDataFrame([(r.item_id, terms.index(r.term)) for r in pairs.collect()], "item int, term int")
    rows = ranked.pruned_terms(numbered, ranked.term_impacts(indexed, n_docs, total), n_docs).collect()
    spared = [r for r in rows if not r.essential]
    assert spared and all(r.suffix < r.threshold for r in spared)
    kth = {}
    for i, r, _, s in plain(docs, items, 10):
        kth[i] = s if r == 10 else 0
    for r in rows:
        assert r.threshold <= kth[r.item] or kth[r.item] == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(none, items).collect() == []
    assert ranked.search(some, items.limit(0)).collect() == []
    assert [tuple(r) for r in ranked.search(some, items).collect()] == plain([(1, "a b")], [(1, "a b")], 10)


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op13_ranked_search"]).fetchall())
    assert want and sorted(tuple(r) for r in queries.QUERIES["op13_ranked_search"](spark, sf_dir).collect()) == want

"""Near-duplicate classes of the pipeline's stage against all pairs."""

import random

import numpy as np

from strandset.llm import nearset, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def corpus():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " ", "one two", "One  TWO", "a b c d e", "z " * 500]
    line = " ".join(rng.choice(words) for _ in range(12))  # a line that many texts share
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        texts.append(" ".join(base) + ("\n" + line if k % 3 else ""))
        for _ in range(rng.randint(0, 5)):
            base = list(base)  # each copy from the one before: chains
            for _ in range(rng.randint(1, 2)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base) + ("\n" + line if k % 3 else ""))
    big = [rng.choice(words) for _ in range(120)]  # a large group of near copies
    for _ in range(60):
        copy = list(big)
        copy[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(copy))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_copies_with_a_few_words_changed_go(spark):
    rng = random.Random(1)
    base = [f"v{k}" for k in range(200)]
    copy = list(base)
    for k in (20, 90, 150):
        copy[k] = "other"
    assert (simhash.fingerprint_of(" ".join(base).encode()) ^ simhash.fingerprint_of(" ".join(copy).encode())).bit_count() > simhash.BUDGET
    far = list(base)
    for k in range(0, 200, 10):
        far[k] = "far" + str(rng.random())
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3]


def test_kept_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = plain_kept(rows)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want and len(want) < len(rows) - 80


def test_bitmaps_never_refuse_a_similar_pair():
    rng = np.random.default_rng(3)
    refused = 0
    for n in (0, 1, 5, 40, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            keep = rng.random(len(a)) < rng.choice([1, 0.95, 0.9, 0.5, 0])
            b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 63, rng.integers(0, n // 8 + 1), dtype=np.uint64)]))
            may = nearset.may_be_similar(nearset.bitmap(a), nearset.bitmap(b), len(a) + len(b))
            assert may or not nearset.similar(a, b)
            refused += not may
    assert refused > 40


def test_order_and_dealing_do_not_change_the_links(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    none = nearset.common_shingles(df.limit(0))
    assert len(none[0]) == 0
    assert {r.component_id for r in nearset.classes_of(df, none).collect()} == plain_kept(rows)
    monkeypatch.setattr(nearset, "COMMON_TEXTS", 3)  # nearly all shared shingles are dealt to several tasks
    assert {r.component_id for r in nearset.classes_of(df, nearset.common_shingles(df)).collect()} == plain_kept(rows)


def test_empty_table_and_missing_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "c d"), (7, "c d")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["4", "4"]
    assert simhash.keep_one(df.where("doc_id > 99")).count() == 0


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(2, "a b c", "x", 1), (1, "a b c", "y", 2), (3, None, "z", 3)], "doc_id long, text string, _id string, component_id int")
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "a b c", "y", 2), (3, None, "z", 3)]


def test_fingerprints_link_what_sets_do_not(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(10, some(8) + " red green blue" * 300), (11, some(8) + " red green blue" * 300), (12, "red green blue " * 300 + some(9))]
    base = [rng.choice(words) for _ in range(120)]
    rows += [(5, " ".join(base)), (6, " ".join([*base[:60], "other", *base[61:]])), (7, some(90)), (8, None), (9, "")]
    rows += [(20, rows[1][1] + " more")]  # by its set it is near 11 only
    sets, fps = [plain_set(t) for _, t in rows], [simhash.fingerprint_of((t or "").encode()) for _, t in rows]
    least = {d: d for d, _ in rows}
    for _ in rows:
        for i, (d, _) in enumerate(rows):
            for j, (e, _) in enumerate(rows):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= simhash.BUDGET:
                    least[d] = least[e] = min(least[d], least[e])
    assert plain_kept(rows) - set(least.values()) == {11, 12}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(least.values()) == {5, 7, 8, 10}

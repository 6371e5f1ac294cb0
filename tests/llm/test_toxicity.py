"""Restored words and held-out accuracy on labelled texts."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandset.llm import toxicity as t

GOOD = "the of and river stone walks under bright morning quietly among old trees with little birds house window garden people water letter".split()
BAD = ["idiot", "moron", "pathetic", "stupid", "worthless"]
DISGUISE = {"i": "1!", "o": "0", "e": "3", "a": "@4", "s": "$5", "t": "7"}


def disguise(rng, word):
    out = [rng.choice(DISGUISE[c]) if c in DISGUISE and rng.random() < 0.6 else c for c in word]
    how = rng.randrange(3)
    if how == 0:
        return "".join(out)
    if how == 1:
        return " ".join(word)
    k = rng.randrange(len(word))
    return word[:k] + word[k] * 4 + word[k + 1 :]


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randint(5, 60))]
        toxic = int(i % 4 == 0)
        for _ in range(rng.randint(1, 3) * toxic):
            w = rng.choice(BAD)
            words.insert(rng.randrange(len(words)), disguise(rng, w) if rng.random() < 0.5 else w + rng.choice(["", ".", ",", "!"]))
        docs.append((i, " ".join(words), 0.5, "en"))
        if i % 5:
            labels.append((i, 1, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score double, lang string").repartition(6),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_restores_disguised_words(spark):
    docs, labels = corpus()
    model = t.letter_model(frames(spark, docs, labels)[0])
    got = {w: t.readings(w, model) for w in ("1d1ot", "m0r0n", "p@7het1c", "stuuuupid", "w-o-r-t-h-l-e-s-s", "st.u.pid")}
    assert "idiot" in got["1d1ot"] and "moron" in got["m0r0n"] and "pathetic" in got["p@7het1c"] and "stupid" in got["stuuuupid"]
    assert "worthless" in got["w-o-r-t-h-l-e-s-s"] and "stupid" in got["st.u.pid"]
    assert t.readings("garden,", model) == {"garden"}


def test_letter_counts_equal_plain(spark):
    texts = ["Ab a!", None, "é9\n\nz", "ab" * 3000]
    df = spark.createDataFrame([(x, 1) for x in texts], "text string, n int")
    want = {}
    for x in texts:
        c = [t.CODE.get(ch, 1 if ch.isalpha() else 0) for ch in " " + (x or "").lower() + " "]
        c = [k for i, k in enumerate(c) if i == 0 or k or c[i - 1]]
        for a, b, e in zip(c, c[1:], c[2:]):
            g = (a * t.ALPHABET + b) * t.ALPHABET + e
            want[g] = want.get(g, 0) + 1
    assert {r.gram: r.n for r in t.letter_counts(df).collect()} == want


def test_held_out_accuracy_and_columns(spark):
    docs, labels = corpus()
    d, y = frames(spark, docs, labels)
    rows = t.score(d, y).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    unseen = [(r.predicted, int(r.doc_id % 4 == 0)) for r in rows if r.held_out or r.doc_id % 5 == 0]
    assert len(unseen) > 200 and sum(a == b for a, b in unseen) >= 0.95 * len(unseen)
    kept = {r.doc_id for r in t.without_toxic(d, y).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted} and t.without_toxic(d, y).columns == d.columns


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(300)
    d, y = frames(spark, docs, labels)
    flipped = y.withColumn("toxic", F.when(t.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a = {r.doc_id: r.score for r in t.score(d, y).collect()}
    b = {r.doc_id: r.score for r in t.score(d, flipped).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_edge_cases(spark):
    docs = [(1, None, 0.0, "en"), (2, "", 0.0, None), (2, "", 0.0, None), (None, "x " * 9000, 0.0, "en")]
    d, y = frames(spark, docs, [(1, 1, None), (None, 1, 1), (7, 1, 0)])
    rows = t.score(d, y).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {rows[0].score} and not any(r.predicted for r in rows)
    assert t.score(d.where("doc_id = 5"), y).count() == 0
    assert t.score(d, y.where("doc_id = 99")).count() == 4


def test_runs_and_tokens_are_read_whole(spark):
    docs, labels = corpus()
    d, y = frames(spark, docs, labels)
    plain = "the river stone walks under bright morning with little birds"
    long = " ".join(plain.replace(" ", ""))
    hidden = ["y i d i o t", "a s t u p i d", long + " i d i o t", "-".join(plain.replace(" ", "")) + "-i-d-i-o-t", "river" * 20 + "-1d1ot", "a" * 300 + "-m0r0n", "a t h e m o r o n"]
    clean = [long, " ".join("garden"), plain, "-".join(plain.replace(" ", "")), "river" * 20]
    more = [(10_000 + i, x, 0.5, "en") for i, x in enumerate(hidden)] + [(20_000 + i, x, 0.5, "en") for i, x in enumerate(clean)]
    rows = {r.doc_id: r.predicted for r in t.score(d.union(frames(spark, more, labels)[0]), y).collect()}
    assert [x for i, x in enumerate(hidden) if not rows[10_000 + i]] == []
    assert [x for i, x in enumerate(clean) if rows[20_000 + i]] == []


def test_signs_at_the_edge_reach_the_lattice(spark):
    docs, labels = corpus()
    model = t.letter_model(frames(spark, docs, labels)[0].union(frames(spark, [(1, "a glass of grass and moss " * 40, 0.5, "en")], labels)[0]))
    assert "glass" in t.readings("gla$$", model) and "moss" in t.readings("mo$$", model) and "idiot" in t.readings("1d1o+", model)


def test_cut_words():
    words = {"a": 3.0, "stupid": 9.0, "idiot": 9.0, "class": 8.0, "ass": 8.0}
    assert t.cut_words("astupid", words)[::-1] == ["a", "stupid"] and t.cut_words("yidiot", words)[::-1] == ["y", "idiot"]
    assert t.cut_words("class", words) == ["class"] and t.cut_words("", words) == []


def all_readings(token, borders):
    """Every reading of a token with its channel cost, by trying each choice for each character."""
    out, before = [("", 0.0)], ""
    for ch in token:
        if ch.isalpha():
            options = [(ch, 0.0)] + [("", t.COST_REPEAT)] * (ch == before)
        else:
            drop, border = (t.COST_DROP_SIGN, t.COST_DROP_SIGN) if ch in t.LEET else (t.COST_SEPARATOR, t.COST_BORDER)
            options = [(c, t.COST_SIGN) for c in t.LEET.get(ch, "")] + [("", drop)] + [(" ", border)] * borders
            options += [("", t.COST_REPEAT)] * (ch == before) + [(ch, t.COST_KEEP)] * (ch in t.LEET)
        out = [(r + o, c + p) for r, c in out for o, p in options if o != " " or (r and r[-1] != " ")]
        before = ch
    return out


def spelled(reading, model):
    """Cost of letters under the language model, words set off by borders."""
    a, b, cost = 0, 0, 0.0
    for ch in reading:
        c = 0 if ch == " " else t.CODE.get(ch, 1)
        cost += float(model[a, b, c])
        a, b = b, c
    return cost + (float(model[a, b, 0]) if b else 0.0)


def test_decoder_finds_the_cheapest_of_all_readings():
    rng = np.random.default_rng(7)
    model = rng.random((t.ALPHABET, t.ALPHABET, t.ALPHABET)).astype(np.float32) * 5
    for token in ("1d1ot", "a$$", "s-t-u", "heeello", "b@d6", "x.1_y", "00", "i-d-1-0-t", "!!a||", "ab", "$"):
        for borders in (False, True):
            costs = {}
            for reading, cost in all_readings(token, borders):
                costs[reading] = min(cost + spelled(reading, model), costs.get(reading, 1e9))
            got = t.restore(token, model, borders)
            assert costs[got] <= min(costs.values()) + 1e-4, (token, got)


def test_spaced_letters_over_any_blanks():
    assert "i-d-i-o-t" in t.tokens_of("you i  d\ti o   t now")
    long = "h e l l o " * 10 + "i d i o t"
    assert long.replace(" ", "-") in t.tokens_of("x1 " + long + " end")


def test_all_labelled_rows_are_fitted(spark):
    docs = [(i, f"river stone {'idiot' if i % 12 == 0 else 'house'}", 0.5, "en") for i in range(11_000)]
    labels = [(i, 1, int(i % 12 == 0)) for i in range(11_000)] + [(5, 1, 1), (20_000, 1, 1), (6, 1, None)]
    d, y = frames(spark, docs, labels)
    rows = {r.doc_id: r.toxic for r in t.training_rows(d, y).select("doc_id", "toxic").collect()}
    assert rows == {i: int(i % 12 == 0 or i == 5) for i in range(11_000) if zlib.crc32(str(i).encode()) % 5}
    _, weights, _, words = t.fit(d, y)
    n1, n0 = sum(rows.values()) - 1, len(rows) - sum(rows.values())  # all toxic rows but one have the word
    assert abs(weights["w:idiot"] - float(t.log_odds(np.array([n1]), np.array([0]), n1 + 1, n0)[0])) < 1e-9
    places = {"river": n1 + 1 + n0, "stone": n1 + 1 + n0, "idiot": n1, "house": n0 + 1}
    assert all(abs(words[w] - np.log(sum(places.values()) / n)) < 1e-9 for w, n in places.items())


def test_newton_sums_equal_one_matrix(spark):
    rng = np.random.default_rng(4)
    e = rng.random((400, t.EVIDENCE))
    y = (rng.random(400) < 1 / (1 + np.exp(2 - 4 * e[:, 0]))).astype(int)
    df = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(y, e)], "y int, " + ", ".join(f"e{k} double" for k in range(t.EVIDENCE))).repartition(5)
    beta = t.fit_logistic(df)
    x = np.column_stack([np.ones(400), e])
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs(x.T @ (p - y) + 1e-2 * beta).max() < 1e-4


def test_a_full_memory_changes_no_evidence(monkeypatch):
    docs, _ = corpus(200)
    model = np.random.default_rng(2).random((t.ALPHABET,) * 3).astype(np.float32)
    weights, words = {"w:idiot": 2.0, "p4:stup": 1.5, "p5:moron": 1.0, "p6:pathet": 3.0}, {"stone": 2.0, "idiot": 3.0}
    whole = t.Scorer(model, weights, words)
    want = [whole.evidence(x) for _, x, *_ in docs]
    monkeypatch.setattr(t, "MEMO", 4)
    small = t.Scorer(model, weights, words)
    assert [small.evidence(x) for _, x, *_ in docs] == want and any(map(any, want))
    assert len(small.memo) <= 6 and len(small.newer) <= 4 and len(small.older) <= 4


def test_sifted_tokens_give_the_same_evidence(monkeypatch):
    docs, _ = corpus(200)
    texts = [x for _, x, *_ in docs] + [None, "", "  \n", "a", "i d i o t", "x i\x1cd\ti o t", "stupid, (Idiot) 'PATHETIC'", "İdiot ΟΔΟΣ ßtupid \U0001d41aidiot", "stuupid stuuupid", "...", "1d1ot idiot. idiot.", "pathetical " * 40]
    model = np.random.default_rng(2).random((t.ALPHABET,) * 3).astype(np.float32)
    weights = {"w:idiot": 2.0, "p4:stup": 1.5, "p5:moron": 1.0, "p6:pathet": 3.0, "w:οδος": 1.0, "w:ßtupid": 2.5}
    scorer = t.Scorer(model, weights, {"stone": 2.0, "idiot": 3.0})
    want = [scorer.evidence(x) for x in texts]
    assert scorer.all_evidence(texts).tolist() == want and sum(map(any, want)) > 40
    # plain words that say nothing are not looked up one by one
    found = list(scorer.sieve.tokens(["the river Stone walks, idiot idiot under 1d1ot stupidly"]))
    assert found == [{"idiot": 2, "1d1ot": 1, "stupidly": 1}]
    monkeypatch.setattr(t, "SIFTED_CHARS", 60)  # groups of a few texts, and texts that are too long for one
    assert scorer.all_evidence(texts).tolist() == want and scorer.all_evidence([]).shape == (0, t.EVIDENCE)


def test_feature_counts_equal_plain(spark, monkeypatch):
    docs, labels = corpus(300)
    d, _ = frames(spark, docs, labels)
    model = t.letter_model(d)
    shared = spark.sparkContext.broadcast((model.tolist(), {"stone": 2.0, "idiot": 3.0}))
    want = {}
    for _, text, *_ in docs:
        words = {w for x in t.tokens_of(text) for w in t.readings(x, model, {"stone": 2.0, "idiot": 3.0})}
        for f in {f for w in words for f in t.features_of(w)}:
            want[f] = want.get(f, 0) + 1
    assert {r.feature: r.n for r in t.feature_counts(d, shared).collect()} == want
    some = {k: {f.split(":")[1] for f in list(sorted(want))[::3] if f.startswith(f"p{k}:" if k else "w:")} for k in (0, 4, 5, 6)}
    got = {r.feature: r.n for r in t.feature_counts(d, shared, spark.sparkContext.broadcast(some)).collect()}
    assert got == {f: want[f] for f in sorted(want)[::3]}


def test_texts_without_a_label_are_left_out_before_the_join(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'text' AS text").union(spark.createDataFrame([(None, "none"), (5, "again")], "doc_id long, text string"))
    marked = spark.range(0, 4000, 10).selectExpr("id AS doc_id", "1 AS toxic")
    left = t.may_be_marked(docs, marked)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and set(range(0, 3000, 10)) <= set(ids) and len(ids) < 320
    other = marked.withColumn("doc_id", F.col("doc_id").cast("decimal(10,0)"))
    assert t.may_be_marked(docs, other).count() == 3002


def test_endings_are_remembered_without_a_change():
    model = np.random.default_rng(9).random((t.ALPHABET,) * 3).astype(np.float32).tolist()
    endings = {}
    for token in ("heello", "heel$$$", "feel$$$", "wheel$$$", "s-t-u", "$$", "a", "st.u.pid", "bee", "be3", "e3"):
        for borders in (False, True):
            assert t.restore(token, model, borders, endings) == t.restore(token, model, borders)
    held = len(endings)
    assert t.restore("awheel$$$", model, False, endings) == t.restore("awheel$$$", model) and len(endings) == held  # after "he" as well

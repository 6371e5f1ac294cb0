"""Segmentation sums against listing all segmentations, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from strandset.llm import langid, queries

PIECES = sorted({bytes([b]) for b in range(256)} | {b" t", b" th", b"he", b"the", b" the", b"an", b"nd", b"and", b" a", "é".encode(), "ét".encode()})


def cuts(word):
    """All segmentations of a word with its blank."""
    whole = b" " + word
    for k in range(len(whole)):
        for at in combinations(range(1, len(whole)), k):
            parts = [whole[a:b] for a, b in zip((0, *at), (*at, len(whole)))]
            if all(p in PIECES for p in parts):
                yield parts


def test_forward_equals_listing():
    rng = np.random.default_rng(3)
    p = rng.random((len(PIECES), 3))
    p /= p.sum(0)
    words = [b"the", b"theand", b"xyz", "étét".encode(), b"a", b"thethe"]
    got = langid.log_probabilities(words, langid.Pieces(PIECES), langid._scaled(PIECES, p))
    for w, row in zip(words, got):
        want = sum(np.prod([p[PIECES.index(x)] for x in c], axis=0) for c in cuts(w))
        assert np.allclose(row, np.log(want), rtol=1e-12)


def test_expected_counts_equal_listing():
    rng = np.random.default_rng(4)
    p = rng.random((len(PIECES), 1))
    words, n = [b"the", b"theand", b"ann", b"and"], np.array([5.0, 1.0, 2.0, 7.0])
    want = np.zeros(len(PIECES))
    for w, c in zip(words, n):
        each = [(np.prod([p[PIECES.index(x), 0] for x in s]), s) for s in cuts(w)]
        for q, s in each:
            for x in s:
                want[PIECES.index(x)] += c * q / sum(q for q, _ in each)
    got = langid.expected_counts(words, n, langid.Pieces(PIECES), langid._scaled(PIECES, p))
    assert np.allclose(got, want)


def test_long_rare_words_stay_finite():
    pieces = langid.vocabulary()
    p = langid._smoothed(np.zeros((len(pieces), 2)))
    assert np.allclose(p.sum(0), 1)
    words = ["日本語".encode()[: langid.STRETCH - 1], b"q" * (langid.STRETCH - 1), bytes(range(200, 231))]
    assert np.isfinite(langid.log_probabilities(words, langid.Pieces(pieces), langid._scaled(pieces, p))).all()
    assert all(len(b" " + w) <= langid.STRETCH for ws in langid.words_of("ab " + "é" * 1000) for w in ws)


LETTERS = {"xa": "aeioubcd", "xb": "aeiouklm", "xc": "äöüéaeio"}


def corpus(n=240):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(LETTERS))
        rows.append((i, " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 9))) for _ in range(rng.choice([3, 10, 60]))), lang))
    return rows


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


ODD = [(900, None, "xa"), (901, "", "xb"), (902, " 12 .,-— 5", "xc"), (903, "bcd " * 60_000, None), (904, "é" * 5000, None), (None, "klm kml", None), (None, "klm kml", None), (5, "bcda abcd", None), (905, "BCD ABC", None)]


def test_counts_rows_and_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(langid, "COUNTED_WORDS", 50)
    monkeypatch.setattr(langid, "PIECE_BYTES", 64)
    rows = corpus() + ODD
    df = spark.createDataFrame([(*r, "z", b"z") for r in rows], "doc_id long, text string, lang string, word string, n binary").repartition(5)
    want = Counter()
    for _, text, lang in rows:
        if lang and text:
            low = "".join(c if c.isalpha() else " " for c in text.lower().replace("—", " "))
            want.update((lang, w.encode()) for w in low.split())
    got = {(r.lang, bytes(r.word)): r.n for r in langid.word_counts(df).collect() if bytes(r.word) != "—".encode()}
    assert got == dict(want)
    out = langid.identify(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, _, _ in rows)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in out)
    truth = {i: lang for i, _, lang in corpus()}
    tested = [r for r in out if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(tested) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.95 * len(tested)
    by = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id >= 900}
    assert [by[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    assert [by[k].lang_pred for k in (903, 904, 905)] == ["xa", "xc", "xa"]
    assert [r.lang_pred for r in out if r.doc_id is None] == ["xb", "xb"]


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = corpus(60)
    kind = "doc_id long, text string, lang string"
    a = langid.identify(spark.createDataFrame(rows, kind)).collect()
    wrong = [(i, t, "xz" if held(i) else lang) for i, t, lang in rows]
    b = langid.identify(spark.createDataFrame(wrong, kind)).collect()
    assert [(r.doc_id, r.lang_pred) for r in a] == [(r.doc_id, r.lang_pred) for r in b]
    assert all(math.isclose(x.score, y.score) for x, y in zip(a, b))


def test_nothing_learnt_and_empty(spark):
    kind = "doc_id long, text string, lang string"
    out = langid.identify(spark.createDataFrame([(1, "abc", None), (2, None, None)], kind)).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)] * 2
    assert langid.identify(spark.createDataFrame([], kind)).collect() == []
    with pytest.raises(ValueError):
        langid.fit(spark.range(langid.MAX_LANGUAGES + 1).selectExpr("'a' AS text", "cast(id as string) AS lang"))


def test_query_on_the_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    out = queries.QUERIES["op12_language_id"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)

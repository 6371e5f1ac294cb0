"""Line deduplication against a walk over all windows."""

import hashlib
import random
import re

import duckdb

from strandset.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, min_words):
    """Delete runs of min_words words or more that occurred earlier; every pair of windows is looked at."""
    def order(row):
        return (row[0] is not None, row[0] or 0)

    docs = sorted({r for r in rows if r[1] is not None}, key=order)
    seen, gone = {}, {}
    for d, text in docs:
        lines = text.split("\n")
        real = [(p, x, len(WORD.findall(x))) for p, x in enumerate(lines) if WORD.search(x)]
        found = []
        for i in range(len(real)):
            n = 0
            for j in range(i, len(real)):
                n += real[j][2]
                tight = n - real[i][2] < min_words or n - real[j][2] < min_words
                if n >= min_words and tight:
                    found.append((real[i][0], real[j][0], tuple(x for _, x, _ in real[i : j + 1])))
        for a, b, key in sorted(found):
            if key in seen and seen[key] != (d, a):
                gone.setdefault((d, text), set()).update(range(a, b + 1))
            seen.setdefault(key, (d, a))
    out = {}
    for d, text in rows:
        if text is None:
            out[d] = (0, 0, None)
            continue
        lines, cut = text.split("\n"), gone.get((d, text), set())
        kept = "\n".join(x for p, x in enumerate(lines) if p not in cut)
        out[d] = (len(lines), len(cut), hashlib.sha256(kept.encode()).hexdigest())
    return out


def tight_only(rows, min_words):
    return plain(rows, min_words)


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))) for _ in range(14)] + ["", " \t", "é ü"]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(n)] + [(900, None), (901, ""), (902, "\n\n"), (903, "x " * 4000), (904, "x " * 4000)]


def run(spark, rows, min_words):
    df = spark.createDataFrame([(d, t, "q", 3) for d, t in rows], "doc_id long, text string, _doc string, start int")
    return {r.doc_id: (r.n_lines, r.n_deleted, r.kept_sha256) for r in linededup.line_dedup(df.repartition(4), min_words).collect()}


def test_equals_plain(spark):
    for seed, least in ((1, 3), (2, 6), (3, 12)):
        rows = corpus(seed)
        assert run(spark, rows, least) == plain(rows, least)


def test_passage_goes_from_later_documents_only(spark):
    passage = "\n".join(["some words here " * 9, "more words there " * 8, "z " * 9])
    rows = [(5, "intro five\n" + passage + "\ntail"), (3, passage + "\nthree"), (8, "only short\nAll rights reserved."), (9, "All rights reserved.\nother")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.delete_repeated(df).collect()}
    assert got == {5: "intro five\ntail", 3: rows[1][1], 8: rows[2][1], 9: rows[3][1]}


def test_sql_agrees(spark):
    rows = [(d, t) for d, t in corpus(7, 40)] + [(950 + i, "\n".join(["w%d " % (k % 5) * 20 for k in range(i, i + 5)])) for i in range(4)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = {r[0]: tuple(r[1:]) for r in con.execute("select doc_id, n_lines, n_deleted, kept_sha256 from (" + linededup.ORACLE + ")").fetchall()}
    assert run(spark, rows, 50) == want


def test_repeats_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a " * 60), (1, "a " * 60), (1, "a " * 60), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_deleted) for r in linededup.line_dedup(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 0), ("None", 0)]
    assert linededup.line_dedup(df.where("doc_id = 77")).count() == 0


def test_fewer_places_than_lines_meet(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(f"w{rng.randint(0, 10**6)} " * rng.randint(2, 9) for _ in range(120))) for i in range(20)]
    rows += [(50 + i, t) for i, (_, t) in enumerate(rows[:4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    places = linededup.selected_places(df).count()
    assert 0 < places < 24 * 120 / 2
    assert run(spark, rows, 50) == plain(rows, 50)


def test_clashing_columns_stay(spark):
    rows = [(1, "a " * 60, "t", ["q"], 5, 6.0, 7, True, "e"), (2, "a " * 60 + "\nb", "u", ["r"], 8, 9.0, 10, False, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _lines array<string>, _h int, _text double, n_chars long, deleted boolean, `row.x` string")
    out = linededup.delete_repeated(df, chars="n_chars")
    assert out.schema == df.schema
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, "b", *rows[1][2:6], 1, *rows[1][7:])]

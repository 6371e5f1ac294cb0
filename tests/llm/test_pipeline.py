"""Each pipeline stage on its own input against a plain version, and the whole run."""

import random

import pytest

import corpus_pipeline
from strandset.llm import decontam, linededup, queries
from tests.llm.test_decontam import plain as plain_leaks
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_simhash import plain_classes
from tests.llm.test_toxicity import corpus


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(5)
    docs, labels = corpus(200)
    bench = [(i, " ".join("".join(rng.choice("aeioustr") for _ in range(rng.randint(3, 7))) for _ in range(25))) for i in range(5)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, t, lang, "src", len(t)) for i, t, _, lang in docs]
    rows += [(300 + i, rows[i + 1][1] + "\n" + passage, "en", "src", 1) for i in range(5)]
    rows += [(400 + i, f"head {i} words\n" + b, None, "src", 1) for i, b in bench]
    rows += [(500, None, None, None, None), (501, "", "en", "src", 0), (502, "z " * 9000, "en", "src", 18000), (503, rows[7][1], "en", "src", 5)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in out.collect()}
        rows = [(d, r.text) for d, r in before.items() if "text" in r]
        if k < 4:
            assert out.columns == columns
        if name == "toxicity":
            gone = set(before) - set(after)
            toxic = {i for i in range(0, 200, 4)} & set(before)
            assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic - set(range(300, 306)) - {503}) <= 2
        elif name == "line dedup":
            want = plain_lines(rows, linededup.MIN_WORDS)
            assert set(after) == set(before) and any(w[1] for w in want.values())
            for d, (n, cut, _) in want.items():
                assert (after[d].text == before[d].text) == (cut == 0)
                if cut:
                    assert after[d].n_chars == len(after[d].text)
        elif name == "simhash near-dedup":
            want = plain_classes(rows)
            assert set(after) == {d for d, (_, c) in want.items() if c == d} and len(after) < len(before)
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(before) - set(after) == {d for d, _ in plain_leaks(rows, items)} and set(before) != set(after)
        docs = out
    assert {r.doc_id for r in docs.collect()} == set(before)


def test_whole_run_equals_stages_and_queries_are_named(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert decontam.COVERAGE <= 1

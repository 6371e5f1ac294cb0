"""Queries that once took a part of their table take all of it."""

import duckdb

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def of_sql(name):
    return duckdb.sql(__spark_entry__.oracle_sql()[name].replace("FROM embeddings", f"FROM '{DATA}/embeddings.parquet'")).fetchall()


def test_every_vector_has_neighbours(spark):
    rows = __spark_entry__.queries()["knn_topk"](spark, DATA).collect()
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert len({r.query_id for r in rows}) == n and len(rows) == 5 * n
    want = of_sql("knn_topk")
    assert {(r.query_id, r.neighbour, r["rank"]) for r in rows} == {(q, v, k) for q, v, _, k in want}
    assert all(abs(d - {(r.query_id, r["rank"]): r.distance for r in rows}[q, k]) < 2e-6 for q, _, d, k in want[:50])


def test_the_dimension_is_that_of_all_vectors(spark):
    row = __spark_entry__.queries()["likelihood_dimension"](spark, DATA).first()
    (dimension, n), *_ = of_sql("likelihood_dimension")
    assert row.n == n == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert abs(row.dimension - dimension) < 2e-6

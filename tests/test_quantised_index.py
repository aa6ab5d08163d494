"""Product-quantised index against exact search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import quantised_index as qi
from factloom.operators.dense import dense_search
from tests.test_retrieval import brute, rows


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 18))
    return (centres[r.integers(0, 12, 3000)] + 0.6 * r.normal(size=(3000, 18))).astype(np.float32)


@pytest.fixture(scope="module")
def corpus(spark, vectors):
    data = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data + [(9999, None, 0)], "id bigint, embedding array<float>, tag int").repartition(5).persist()


@pytest.fixture(scope="module")
def queries(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(0, 3000, 100)], "query_id int, vector array<double>")


def test_recall_and_exact_scores(spark, monkeypatch, vectors, corpus, queries, tmp_path):
    monkeypatch.setattr(qi, "BLOCK_ROWS", 100)
    path = str(tmp_path / "ix")
    qi.write_quantised_index(corpus, path, 12, sample=1500)
    stored = spark.read.parquet(f"{path}/vectors")
    assert stored.count() == 3000 and {"tag", "codes"} <= set(stored.columns)
    got = qi.search_quantised_index(spark, path, queries, 10, probes=6)
    exact = {(q, i): s for q, _, i, s in rows(dense_search(corpus, queries, 10))}
    found = {(q, i): s for q, _, i, s in rows(got)}
    assert len(found) == 300 and len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(found[k] == pytest.approx(exact[k], abs=1e-6) for k in found.keys() & exact.keys())
    monkeypatch.setattr(qi, "BLOCK_BYTES", 1)  # one query a block
    assert rows(qi.search_quantised_index(spark, path, queries.limit(3), 10, probes=6)) == [r for r in rows(got) if r[0] in {q.query_id for q in queries.limit(3).collect()}]


def test_all_cells_and_all_estimates_are_exact(spark, vectors, corpus, queries, tmp_path):
    path = str(tmp_path / "ix")
    qi.write_quantised_index(corpus.filter("id < 300"), path, 4)
    asked = queries.filter("query_id < 300")
    want = [(q * 100, r, i, s) for q, r, i, s in brute(vectors[:300], vectors[:300:100], 5)]
    assert rows(qi.search_quantised_index(spark, path, asked, 5, probes=4, shortlist=60)) == sorted(want)


def test_only_codes_of_probed_cells_are_scanned(spark, corpus, queries, tmp_path):
    path = str(tmp_path / "ix")
    qi.write_quantised_index(corpus, path, 12)
    with pytest.raises(ValueError):
        qi.search_quantised_index(spark, path, queries, 5, probes=0)
    plan = qi.search_quantised_index(spark, path, queries.limit(1), 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    assert qi.search_quantised_index(spark, path, queries.limit(0), 5).isEmpty()


def test_codewords_come_near_what_they_stand_for():
    r = np.random.default_rng(2)
    data = r.normal(size=(2000, 10))
    words = qi.fitted_codewords(data)
    codes = qi.encoded(data, np.zeros(10), words)
    back = np.concatenate([words[p][codes[:, p]] for p in range(words.shape[0])], 1)[:, :10]
    assert ((data - back) ** 2).sum() < 0.45 * (data**2).sum()
    assert qi.fitted_codewords(data[:3]).shape == (3, qi.CODES, qi.SUB_DIMENSION)


def test_recall_on_vectors_without_structure(spark, tmp_path):
    """neighbours that hardly stand out from the rest must stay in the shortlist."""
    data = np.random.default_rng(6).normal(size=(5000, 64))
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id bigint, embedding array<float>")
    queries = corpus.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    path = str(tmp_path / "ix")
    qi.write_quantised_index(corpus, path, 8, sample=2500)
    exact = {(q, i) for q, _, i, _ in rows(dense_search(corpus, queries, 10))}
    found = {(q, i) for q, _, i, _ in rows(qi.search_quantised_index(spark, path, queries, 10, probes=8))}
    assert len(found & exact) >= 0.95 * len(exact) == 475


def test_scores_are_rounded_as_the_sql_rounds_them(spark):
    """F2: 0.5047875 times a million is a little less than a half in doubles."""
    import duckdb

    from factloom.plans.retrieval_queries import hits_out

    scores = [0.5047875, -0.5047875, 0.0078125, 0.1234565, 1.0]
    hits = spark.createDataFrame([(0, i, i, s) for i, s in enumerate(scores)], "query_id int, rank int, chunk_id int, score double")
    got = [r.score for r in sorted(hits_out(hits).collect())]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [s]).fetchone()[0] for s in scores]

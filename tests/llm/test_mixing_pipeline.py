"""Mixing, the pipeline, and the queries beside their SQL."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from factloom.llm import mixing
from factloom.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import documents, linked_components, near_copies, odd_rows, words

FOLDER = "/root/testdata/sf0.001"


def reshared(sizes, weights, cap):
    """Targets by the rule as it is told: share, cut at the caps, share the excess, again."""
    goals, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        share = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if share * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                goals[i] = share * weights[i]
            break
        for i in over:
            goals[i] = float(cap * sizes[i])
            left -= goals[i]
            open_.remove(i)
    return goals


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i % 13), None, [None, "a", "B", "é", "tiny"][min(i % 7, 4)] if i % 7 != 4 or i < 30 else "a") for i in range(600)]
    planned = mixing.plan(documents(spark, rows)).collect()
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(words(r[1])) for r in rows if r[3] == s) for s in sources]
    goals = dict(zip(sources, reshared(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], 3)))
    assert sum(goals.values()) == pytest.approx(sum(sizes))
    for r in planned:
        assert r.target == pytest.approx(goals[r.source]) and r.source_size == sizes[sources.index(r.source)]
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1) and r.copies <= 3
    for s in sources:
        assert abs(sum(r.size * r.copies for r in planned if r.source == s) - goals[s]) < 0.25 * goals[s] + 30
    assert sorted(map(str, planned)) == sorted(map(str, mixing.plan(documents(spark, rows, 7)).collect()))
    assert mixing.mix(documents(spark, rows)).count() == sum(r.copies for r in planned)


def test_mixing_odd_rows(spark, monkeypatch):
    df = documents(spark, odd_rows()).withColumnRenamed("n_chars", "size")
    assert {r.doc_id: r.size for r in mixing.plan(df).collect()}[1] == 0
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert mixing.plan(df).count() == len(odd_rows())
    assert mixing.plan(documents(spark, [])).count() == 0
    assert mixing.plan(documents(spark, [(1, None), (2, " ")])).agg({"copies": "sum"}).first()[0] == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = corpus_pipeline.known_language(spark, docs, FOLDER)
    assert known.columns == docs.columns and known.count() >= 0.99 * docs.count()
    rows = near_copies(8, 150)
    kept = corpus_pipeline.one_of_each_group(spark, documents(spark, rows), FOLDER)
    assert {r.doc_id for r in kept.collect()} == {root for _, root in linked_components(rows, 5, 8, 10)}
    said = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    clean = corpus_pipeline.without_benchmarks(spark, documents(spark, [(1, "before " + said + " after"), (2, "clean words"), (3, None)]), FOLDER)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3]
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in docs.select("doc_id").collect()}
    position = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == position
        position += r.n_tokens


def test_empty_and_unlabelled_tables(spark, tmp_path):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows = [(1, "some words here"), (2, None), (3, "12 34"), (4, "other words there"), (None, "x y z")]
    for name, some in (("empty", []), ("unlabelled", rows)):
        folder = str(tmp_path / name)
        documents(spark, some).write.parquet(f"{folder}/documents.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        got = QUERIES["op4_language_id"](spark, folder).collect()
        assert len(got) == len(some) and all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in got)
        kept = corpus_pipeline.known_language(spark, documents(spark, some), folder)
        assert {r.doc_id for r in kept.collect()} == ({1, 4, None} if some else set())
        out = corpus_pipeline.run(spark, folder)
        assert {r.doc_id for r in out.collect()} <= {1, 4, None} and (some or out.count() == 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_all_rows(spark, name):
    if name in ORACLES:
        pytest.skip("compared with SQL by the registry test")
    source = {"op6": "pages", "op9": "conversations"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{FOLDER}/{source}.parquet")
    want = rows.select("conv_id").distinct().count() + 1 if source == "conversations" else rows.count()
    assert entry.queries()[name](spark, FOLDER).count() == want


def test_folder_exists():
    assert os.path.isdir(FOLDER)

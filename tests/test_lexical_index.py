"""The stored index against searches that read the texts."""

import random
import uuid

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.operators import lexical as lx
from factloom.operators import lexical_index as li
from tests.test_retrieval import rows

VOCABULARY = ["risk", "revenue", "cash", "lease", "équité", *(f"w{i}" for i in range(200))]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    weights = [1 / (i + 1) for i in range(len(VOCABULARY))]
    made = [" ".join(r.choices(VOCABULARY, weights, k=r.choice([0, 3, 10, 40, 200]))) for _ in range(3000)]
    return [(f"c{i:05d}", t, "AB"[i % 2], 2024 + i % 3) for i, t in enumerate(made)] + [("none", None, "A", 2024), ("twin1", made[5], "A", 2024), ("twin0", made[5], "A", 2024)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(spark.sparkContext.parallelize(texts, 5), "id string, text string, ticker string, fiscal_year int").persist()


@pytest.fixture(scope="module")
def queries(spark):
    r = random.Random(9)
    asked = [" ".join(r.choice(VOCABULARY) for _ in range(r.choice([1, 2, 5, 12]))) for _ in range(25)] + ["nothing known zzz", "", "w199 W199"]
    return spark.createDataFrame([(i, q, ["A"] if i % 3 == 0 else [], [2025] if i % 4 == 0 else None) for i, q in enumerate(asked)], "query_id int, query string, tickers array<string>, fiscal_years array<int>")


def table():
    return f"lexical_{uuid.uuid4().hex}"


@pytest.mark.parametrize("scorer", ["bm25", "cover_density"])
@pytest.mark.parametrize(("part", "tokens", "block"), [(512, 4_000_000, 5000), (16, 3000, 7)])
def test_index_finds_what_the_texts_hold(spark, monkeypatch, docs, queries, scorer, part, tokens, block):
    monkeypatch.setattr(li, "BLOCK_TERMS", block)
    index = li.write_index(docs, table(), 3, part_docs=part, shard_tokens=tokens)
    for asked in (queries, queries.drop("tickers", "fiscal_years")):
        assert rows(li.search_index(spark, index, asked, 9, scorer=scorer)) == rows(lx.lexical_search(docs, asked, 9, scorer=scorer))


def test_most_blocks_are_skipped(spark):
    r = random.Random(2)
    said = [("alpha " * (5 if i < 20 else r.randrange(2)) + "beta " * (3 if 3000 <= i < 3010 else r.randrange(2)) + "filler " * 30).split()[:30] for i in range(4000)]
    docs = spark.createDataFrame([(f"c{i:05d}", " ".join(t)) for i, t in enumerate(said)], "id string, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "query_id int, query string")
    index = li.write_index(docs, table(), 3, part_docs=16)
    counters = [spark.sparkContext.accumulator(0) for _ in range(2)]
    found = li.search_index(spark, index, queries, 3, scorer="bm25", counters=counters)
    assert rows(found) == rows(lx.lexical_search(docs, queries, 3, scorer="bm25"))
    assert counters[1].value > 20 * counters[0].value > 0


def test_no_text_is_stored_and_no_posting_shuffled(spark, docs, queries):
    index = li.write_index(docs, table(), 3)
    assert "text" not in spark.table(index.table).columns
    found = li.search_index(spark, index, queries, 3, scorer="bm25")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Exchange hashpartitioning(query_id" in plan


def test_appended_and_reopened(spark, docs, queries, tmp_path):
    name, path = table(), str(tmp_path / "index")
    first, second = docs.filter(F.col("id") < "c01000"), docs.filter(F.col("id") >= "c01000")
    li.write_index(first, name, 2, path=path)
    li.write_index(second, name, 2, append=True)
    want = rows(lx.lexical_search(docs, queries, 5, scorer="bm25"))
    assert rows(li.search_index(spark, li.LexicalIndex(name), queries, 5, scorer="bm25")) == want
    again = li.open_index(spark, path, 2)
    assert rows(li.search_index(spark, again, queries, 5, scorer="bm25")) == want


def test_empty_index_and_no_queries(spark, docs, queries):
    index = li.write_index(docs.limit(0), table(), 2)
    assert li.search_index(spark, index, queries, 3, scorer="bm25").isEmpty()
    index = li.write_index(docs, table(), 2)
    assert li.search_index(spark, index, queries.limit(0), 3).isEmpty()


def test_equal_scores_go_by_id_at_the_cut():
    schema = pa.schema([("tokens", pa.list_(pa.string())), ("id", pa.string())])
    docs = pa.table({"tokens": [["a"]] * 2000, "id": [f"d{i:05d}" for i in reversed(range(2000))]}, schema=schema)
    fields = [("shard", pa.string()), ("part", pa.int32()), ("term", pa.string()), *((c, pa.int32()) for c in ("n", "max_tf", "min_length")), ("docs", pa.binary()), ("tfs", pa.binary()),
              ("total_length", pa.int64()), ("lengths", pa.binary()), ("all_id", pa.list_(pa.string()))]
    rows_ = pa.Table.from_batches(list(li._inverted(docs, "s", pa.schema(fields))))
    ranking = lx.RANKINGS["cover_density"]
    asked = li.Asked(pd.DataFrame({"query_id": [1]}), pa.array(["a"]), [[0]], "cover_density", ranking.idf(0, [0]), 1.0, {}, 3)
    asked.own = [pd.Series([0]).to_numpy()]
    hits, ids, _, _ = li.shard_hits(rows_, asked, li.LexicalIndex("none"))
    assert [ids[i] for i in hits[0][1]] == ["d00000", "d00001", "d00002"]

"""Retrieval against brute force on small fixtures."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import vectors as vx
from factloom.functions.stemming import stem
from factloom.operators import dense as dn
from factloom.operators import embedding as em
from factloom.operators import fusion as fu
from factloom.operators import lexical as lx
from factloom.operators import metrics
from factloom.operators import containment
from factloom.operators.containment import passages_in
from factloom.operators.gates import GateError, enforce
from factloom import scope

WORDS = "risk revenue market the growth of cash lease équité asset income tax rate share profit margin".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return {f"c{i:03d}": " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 60))) for i in range(80)}


@pytest.fixture(scope="module")
def asked():
    return {1: "What is the market RISK of cash?", 2: "équité lease lease", 3: "nothing here matches zzz"}


def frames(spark, texts, asked):
    docs = spark.createDataFrame(list(texts.items()), "id string, text string")
    return docs, spark.createDataFrame(list(asked.items()), "query_id int, query string")


def split(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def ranked(scores, k):
    return [(q, i + 1, d, s) for q, per in scores.items() for i, (d, s) in enumerate(sorted(per.items(), key=lambda x: (-x[1], x[0]))[:k])]


def rows(df, id_col="id"):
    return sorted((r.query_id, r["rank"], r[id_col], round(r.score, 6)) for r in df.collect())


def cover(texts, asked, tokens=split):
    return {q: {d: round(0.1 * n, 6) for d, t in texts.items() if (n := sum(w in set(tokens(text)) for w in tokens(t)))} for q, text in asked.items()}


def test_cover_density(spark, texts, asked):
    docs, queries = frames(spark, texts, asked)
    assert rows(lx.lexical_search(docs, queries, 7)) == sorted(ranked(cover(texts, asked), 7))


def test_english_analyser(spark, texts, asked):
    stems = lambda t: [stem(w) for w in re.findall(r"[^\W_]+", t.lower()) if w not in scope.STOP_WORDS]
    docs, queries = frames(spark, texts, asked)
    assert rows(lx.lexical_search(docs, queries, 5, analyser="english")) == sorted(ranked(cover(texts, asked, stems), 5))


def test_bm25(spark, texts, asked):
    n, lengths = len(texts), {d: len(split(t)) for d, t in texts.items()}
    avg = sum(lengths.values()) / n
    df = Counter(w for t in texts.values() for w in set(split(t)))
    scores = {}
    for q, text in asked.items():
        per = {}
        for d, t in texts.items():
            tf = Counter(split(t))
            hit = [w for w in set(split(text)) if tf[w]]
            if hit:
                per[d] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * lengths[d] / avg)) for w in hit), 6)
        scores[q] = per
    docs, queries = frames(spark, texts, asked)
    assert rows(lx.lexical_search(docs, queries, 9, scorer="bm25")) == sorted(ranked(scores, 9))


def test_bm25_shuffles_no_postings(spark, texts, asked, tmp_path):
    docs, queries = frames(spark, texts, asked)
    docs.write.parquet(str(tmp_path / "d"))
    found = lx.lexical_search(spark.read.parquet(str(tmp_path / "d")), queries, 3, scorer="bm25")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Exchange hashpartitioning(query_id" in plan


def test_request_scope(spark, texts, asked):
    docs, _ = frames(spark, texts, asked)
    tagged = docs.withColumn("ticker", F.when(F.col("id") < "c040", "A").otherwise("B")).withColumn("fiscal_year", F.lit(2024) + (F.length("text") % 2).cast("int"))
    queries = spark.createDataFrame([(1, "risk", ["A"], []), (2, "risk", [], [2025]), (3, "risk", None, None)], "query_id int, query string, tickers array<string>, fiscal_years array<int>")
    for scorer in ("cover_density", "bm25"):
        hits = lx.lexical_search(tagged, queries, 50, scorer=scorer).join(tagged, "id").collect()
        assert {h.ticker for h in hits if h.query_id == 1} == {"A"} and {h.fiscal_year for h in hits if h.query_id == 2} == {2025}
        assert {(h.ticker, h.fiscal_year) for h in hits if h.query_id == 3} == {("A", 2024), ("A", 2025), ("B", 2024), ("B", 2025)}
    encoder = em.hash_encoder(32)
    vectors, vq = em.embed(tagged, encoder), queries.withColumn("vector", encoder(F.col("query")))
    hits = dn.dense_search(vectors, vq, 50).join(tagged, "id").collect()
    assert {h.ticker for h in hits if h.query_id == 1} == {"A"} and len([h for h in hits if h.query_id == 3]) == 50


def test_metadata_filter_reaches_the_scan(spark, texts, asked, tmp_path):
    docs, queries = frames(spark, texts, asked)
    docs.withColumn("ticker", F.lit("A")).write.parquet(str(tmp_path / "d"))
    plan = lx.lexical_search(spark.read.parquet(str(tmp_path / "d")), queries, 3, ticker=["A", "B"])._jdf.queryExecution().executedPlan().toString()
    assert "In(ticker, [A,B])" in plan
    assert lx.metadata_filter(docs, id=[], text=None) is docs


def test_stored_index_needs_no_shuffle_before_top_k(spark, texts, asked, tmp_path):
    docs, queries = frames(spark, texts, asked)
    queries.coalesce(1).write.parquet(str(tmp_path / "q"))
    queries = spark.read.parquet(str(tmp_path / "q"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    lx.write_postings(docs, "postings_test", 4)
    found = lx.search_postings(spark, "postings_test", queries, 7)
    assert rows(found) == sorted(ranked(cover(texts, asked), 7))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(query_id" in plan


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    data[7] = data[3] * 2
    return data


def brute(vectors, queries, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(vectors.astype(float)) @ unit(queries.astype(float)).T, 9)
    return sorted((q, r + 1, int(i), round(float(s[i, q]), 6)) for q in range(s.shape[1]) for r, i in enumerate(sorted(range(len(s)), key=lambda i: (-s[i, q], i))[:k]))


def test_dense_blocks(spark, vectors, monkeypatch):
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(999, None)], "id bigint, embedding array<float>")
    queries = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(20)], "query_id int, vector array<double>")
    want = brute(vectors, vectors[:20], 5)
    assert rows(dn.dense_search(corpus, queries, 5)) == want
    monkeypatch.setattr(dn, "BLOCK_VALUES", 64)
    assert rows(dn.dense_search(corpus, queries, 5)) == want
    assert dn.dense_search(corpus, queries.limit(0), 5).isEmpty()


@pytest.mark.parametrize("other", [[1.0, 2.0], [1.0, None, 3.0]])
def test_dense_refuses_ragged_and_null_vectors(spark, other):
    corpus = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, other)], "id int, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, vector array<double>")
    with pytest.raises(Exception, match="dimensions|NULL element"):
        dn.dense_search(corpus, queries, 1).collect()
    with pytest.raises(Exception, match="dimensions|NULL element"):
        dn.dense_search(corpus.filter("id = 1"), corpus.filter("id = 2").selectExpr("id AS query_id", "embedding AS vector"), 1).collect()


def test_lexical_blocks_and_shuffle(spark, texts, asked, monkeypatch):
    docs, queries = frames(spark, texts, asked)
    want = {s: rows(lx.lexical_search(docs, queries, 3, scorer=s)) for s in lx.SCORERS}
    monkeypatch.setattr(lx, "BLOCK_TERMS", 1)
    monkeypatch.setattr(lx, "COUNTERS", 7)
    for scorer, hits in want.items():
        assert rows(lx.lexical_search(docs, queries, 3, scorer=scorer)) == hits
    monkeypatch.undo()
    plan = lx.lexical_search(docs, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")


def test_fusion(spark):
    make = lambda ids: spark.createDataFrame([(1, i, r + 1, 9.0) for r, i in enumerate(ids)], "query_id int, id string, rank int, score double")
    fused = fu.reciprocal_rank_fusion([make(["a", "b", "c"]), make(["b", "d"])], 3).orderBy("rank").collect()
    assert [r.id for r in fused] == ["b", "a", "d"] and fused[0].score == pytest.approx(1 / 62 + 1 / 61)
    tie = fu.reciprocal_rank_fusion([make(["z"]), make(["a"])], 2).orderBy("rank").collect()
    assert [r.id for r in tie] == ["a", "z"]


def test_hybrid_and_fallback(spark, texts, asked):
    docs, queries = frames(spark, texts, asked)
    encoder = em.hash_encoder(64)
    corpus = em.embed(docs, encoder)
    vq = queries.withColumn("vector", F.when(F.col("query_id") != 2, encoder(F.col("query"))))
    got = fu.retrieve(docs, corpus, vq, 4)
    modes = {(r.query_id, r["mode"]) for r in got.collect()}
    assert modes == {(1, "hybrid"), (2, "lexical"), (3, "hybrid")}


def test_rerank_sees_only_the_shortlist(spark):
    docs = spark.createDataFrame([("a", "cash flow"), ("b", "cash risk flow"), ("c", "cash flow"), ("d", "cash risk flow")], "id string, text string")
    queries = spark.createDataFrame([(1, "cash risk")], "query_id int, query string")
    shortlist = spark.createDataFrame([(1, "a", 1, 0.0), (1, "c", 2, 0.0), (1, "b", 3, 0.0)], "query_id int, id string, rank int, score double")
    got = fu.rerank(shortlist, docs, queries, 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("b", 1.0), ("a", 0.5), ("c", 0.5)]
    assert fu.rerank(shortlist.limit(0), docs, queries, 3).isEmpty()


def test_metrics(spark):
    schema = "query_id int, rank int, accession_no string, item_section string"
    hits = spark.createDataFrame([(1, 1, "x", "MDA"), (1, 2, "a", "MDA"), (1, 3, "a", "MDA"), (1, 6, "b", "MDA"), (2, 1, "c", "RISK")], schema)
    relevant = spark.createDataFrame([(1, "a", "MDA"), (1, "b", "MDA"), (3, "a", "MDA"), (2, "c", "MDA")], "query_id int, accession_no string, item_section string")
    cases = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id int")
    got = {r.query_id: (r.recall, r.reciprocal_rank) for r in metrics.case_scores(hits, relevant, cases).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.0)}
    line = metrics.report_lines(metrics.summary(metrics.case_scores(hits, relevant, cases), "lexical")).first().line
    assert line == "lexical                    0.125     0.125       4"


@pytest.mark.parametrize("block", [500_000, 20])
def test_containment_equals_substring_search(spark, monkeypatch, block):
    monkeypatch.setattr(containment, "BLOCK_CHARS", block)
    rng = random.Random(5)
    words = ["aa", "b", "ccc", "dd\ndd", "e"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    passages = [t[i:j] for t in rng.sample([x for x in texts if len(x) > 20], 12) for i, j in [sorted(rng.sample(range(len(t) + 1), 2))]]
    passages += ["a", "b", "ccc dd", "aa b ccc", "zzz", "c d", " ", "dd\ndd", "absent words entirely here now", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "p int, passage string")
    got = {(r.p, r.d) for r in passages_in(docs, asked, "d", "p").collect()}
    assert got == {(p, d) for p, x in enumerate(passages) if x for d, t in enumerate(texts) if x in t}


def test_containment_is_one_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab abc"), (2, None), (3, "xabcx")], "d int, text string")
    docs.write.parquet(str(tmp_path / "d"))
    asked = spark.createDataFrame([("p", "abc"), ("q", "abc"), ("r", "b"), ("s", None), ("t", "")], "p string, passage string")
    found = passages_in(spark.read.parquet(str(tmp_path / "d")), asked, "d", "p")
    assert sorted((r.p, r.d) for r in found.collect()) == [("p", 1), ("p", 3), ("q", 1), ("q", 3), ("r", 1), ("r", 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan


def test_embed_pending(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "id int, text string")
    stored = docs.select("id", F.when(F.col("id") < 2, F.array(F.lit(1.0))).alias("embedding"))
    encoder = em.hash_encoder(8)
    with pytest.raises(GateError, match="no embedding 2"):
        enforce(em.completeness_gate(stored.orderBy("id")))
    part = em.embed_pending(docs, stored, encoder, limit=3)
    assert sorted(r.id for r in part.collect()) == [0, 1, 2, 3, 4]
    full = em.embed_pending(docs, stored, encoder).collect()
    assert sorted(r.id for r in full) == list(range(6)) and [len(r.embedding) for r in sorted(full, key=lambda r: r.id)] == [1, 1, 8, 8, 8, 8]


def test_embed_pending_weighs_empty_vectors_as_its_sql(spark, tmp_path):
    """two words that cancel out, texts without words and NULL."""
    import duckdb

    from factloom.plans.registered import ORACLES, QUERIES

    slots = {}
    for word in (f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(676)):
        slots.setdefault(vx.slot(word, 256), word)
    bucket = next(b for b, sign in slots if sign > 0 and (b, -1.0) in slots)
    pair = f"{slots[bucket, 1.0]} {slots[bucket, -1.0]}"
    docs = [(1, pair, "fr"), (2, "12 34!", "de"), (3, None, "fr"), (4, "", None), (5, "un deux", "fr"), (6, pair, "en"), (7, "!", "en")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES["embed_pending"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, db.execute(ORACLES["embed_pending"]).fetchall()))


def test_vector_index(spark, vectors, tmp_path):
    from factloom.operators.vector_index import search_vector_index, write_vector_index

    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, embedding array<float>")
    queries = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(3)], "query_id int, vector array<double>")
    write_vector_index(corpus, str(tmp_path / "ix"), 6)
    assert rows(search_vector_index(spark, str(tmp_path / "ix"), queries, 5, probes=6)) == brute(vectors, vectors[:3], 5)
    near = search_vector_index(spark, str(tmp_path / "ix"), queries, 1, probes=1)
    assert sorted(r.id for r in near.collect()) == [0, 1, 2]
    together = rows(search_vector_index(spark, str(tmp_path / "ix"), queries, 5, probes=1))
    assert together == sorted(r for q in range(3) for r in rows(search_vector_index(spark, str(tmp_path / "ix"), queries.filter(F.col("query_id") == q), 5, probes=1)))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan

"""Claims, the answer loop, serving, streaming and the archive source."""

import json
import urllib.error

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import scope
from factloom.model import FILING
from factloom.operators import claims as cl
from factloom.operators.embedding import hash_encoder
from factloom.operators.rate_limit import token_bucket
from factloom.plans.answering import answer, dictionary_planner, extractive_drafter
from factloom.serving import tools
from factloom.serving.service import AnswerService
from factloom.sources import remote
from factloom.streaming import jobs


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("n25:0000", "n25", "NVDA", 2025, "MDA", "NVIDIA revenue grew to $130.5 billion.\nData center led."),
        ("n24:0000", "n24", "NVDA", 2024, "MDA", "NVIDIA net income was $29.8 billion in the year."),
        ("a25:0000", "a25", "AAPL", 2025, "RISK_FACTORS", "Apple faces supply risks."),
    ]
    return spark.createDataFrame(rows, "chunk_id string, accession_no string, ticker string, fiscal_year int, item_section string, text string")


@pytest.fixture(scope="module")
def anchors(spark):
    rows = [("NVDA", "Revenues", 2025, 130497.0, "USD", "2025-01-26", "n25"), ("NVDA", "NetIncomeLoss", 2024, 29760.0, "USD", "2024-01-28", "n24")]
    df = spark.createDataFrame(rows, "ticker string, concept string, fiscal_year int, value double, unit string, d string, accession_no string")
    return df.select("ticker", "concept", "fiscal_year", "value", "unit", F.to_date("d").alias("period_end"), "accession_no", F.lit(False).alias("restated"))


@pytest.fixture(scope="module")
def corpus(chunks, anchors):
    encoder = hash_encoder(32)
    vectors = chunks.withColumn("embedding", encoder(F.col("text")))
    return tools.Corpus(chunks, vectors, anchors, anchors, encoder)


def claim(spark, **kw):
    base = dict(ticker="NVDA", fiscal_year=2025, value=130_000.0, period="FY2025", concept="revenue")
    row = {**base, **kw}
    return spark.createDataFrame([tuple(row.values())], "ticker string, fiscal_year int, value double, period string, concept string")


@pytest.mark.parametrize(
    ("changes", "method", "verified"),
    [({}, "xbrl", True), ({"value": 120_000.0}, "xbrl", False), ({"value": None}, "extractive", True), ({"concept": None}, "unverified", False),
     ({"concept": "head count"}, "unverified", False), ({"period": "fiscal 2024", "concept": "net income", "value": 29_760.0}, "xbrl", True), ({"ticker": "AAPL"}, "unverified", False)],
)
def test_verification(spark, anchors, changes, method, verified):
    row = cl.verify(claim(spark, **changes), anchors).first()
    assert (row.method, row.verified) == (method, verified)


def test_planner_stays_in_scope(spark):
    ask = spark.createDataFrame([(1, "How did Apple and NVDA revenue in 2024 compare with 2019?", 0), (2, "What about TSLA's stockholders' equity?", 0)], "request_id int, question string, replans int")
    plans = {r.request_id: r for r in cl.clamp_plan(dictionary_planner()(ask)).collect()}
    assert set(plans[1].tickers) == {"AAPL", "NVDA"} and plans[1].fiscal_years == [2024] and plans[1].concepts == ["revenue"]
    assert plans[2].tickers == [] and plans[2].concepts == ["stockholders equity"]


def test_answers(spark, chunks, anchors):
    ask = spark.createDataFrame([(1, "What was NVDA revenue for fiscal 2025?"), (2, "Which supply risks does Apple face?"), (3, "qqq zzz")], "request_id int, question string")
    memos = {r.request_id: r for r in answer(ask, chunks, anchors).collect()}
    first = memos[1].claims[0]
    assert first.value == 130497.0 and first.verification.method == "xbrl" and first.citation.chunk_id == "n25:0000" and memos[1].verified_fraction == 1.0
    assert memos[2].claims[0].verification.method == "extractive" and memos[2].claims[0].citation.quote_span == "Apple faces supply risks."
    assert memos[3].answer_summary == "(no claims)" and memos[3].replans == scope.MAX_REPLANS and memos[3].notes == ["no_hits"] * 3


def test_wrong_figures_are_replanned_and_disclosed(spark, chunks, anchors):
    def liar(plans, hits, facts):
        return extractive_drafter(plans, hits, facts).withColumn("value", F.col("value") * 2)

    ask = spark.createDataFrame([(1, "NVDA revenue for fiscal 2025?")], "request_id int, question string")
    memo = answer(ask, chunks, anchors, drafter=liar).first()
    assert memo.replans == 3 and memo.n_unverified == 1 and memo.confidence_notes and memo.verified_fraction == 0.0


def test_uncitable_drafts_are_dropped(spark, chunks, anchors):
    def forger(plans, hits, facts):
        return extractive_drafter(plans, hits, facts).withColumn("quote", F.lit("never written"))

    ask = spark.createDataFrame([(1, "NVDA revenue for fiscal 2025?")], "request_id int, question string")
    memo = answer(ask, chunks, anchors, drafter=forger).first()
    assert memo.claims == [] and memo.notes == ["uncited: 1"]


def test_prompt_blocks(spark, chunks):
    hits = chunks.withColumn("request_id", F.lit(1)).withColumn("rank", F.row_number().over(Window.orderBy("chunk_id")))
    text = cl.render_excerpts(hits, ["request_id"]).first().excerpts
    assert text.startswith('<passage no="0" from="AAPL / 2025 / RISK_FACTORS">\nApple') and text.count("</passage>") == 3


def test_tools(spark, corpus):
    ask = spark.createDataFrame([(1, "supply risks", ["AAPL"], [])], "query_id int, query string, tickers array<string>, fiscal_years array<int>")
    hit = tools.search(corpus, ask).orderBy("rank").first()
    assert hit.citation == "a25#RISK_FACTORS#a25:0000" and hit["mode"] == "hybrid"
    with pytest.raises(ValueError, match="top_k"):
        tools.search(corpus, ask, 51)
    found = tools.lookup(corpus, spark.createDataFrame([("nvda", "revenue", 2025), ("nvda", "total assets", 2025)], "ticker string, label string, fiscal_year int"))
    assert {r.label: r.found for r in found.collect()} == {"revenue": True, "total assets": False}
    assert json.loads(tools.calculate_json("2*3"))["value"] == 6.0 and "error" in json.loads(tools.calculate_json("__import__('os')"))
    assert tools.corpus_scope()["forms"] == ["10-K", "10-Q"] and json.loads(tools.as_json(found).first().json)["ticker"] == "NVDA"


def test_sql_functions(spark, corpus):
    tools.register_sql(spark, corpus)
    assert spark.sql("SELECT calculate('1+2').value AS v").first().v == 3.0
    assert spark.sql("SELECT * FROM lookup_fact('nvda', 'Revenues', 2025)").first().value == 130497.0
    got = spark.sql("SELECT * FROM search_documents('Apple supply', 2) ORDER BY place").collect()
    assert got[0].chunk_id == "a25:0000" and got[0].score == pytest.approx(0.2)


def service(spark, corpus, key="k"):
    now = [0.0]
    made = AnswerService(spark, corpus, key=lambda: key, new_bucket=lambda: remote.TokenBucket(1.0, 2.0, clock=lambda: now[0]))
    return made, now


def test_service(spark, corpus):
    made, now = service(spark, corpus)
    assert made.ask("What was NVDA revenue for fiscal 2025?", None).status == 401
    assert service(spark, corpus, key="")[0].ask("question", "k").status == 503
    reply = made.ask("What was NVDA revenue for fiscal 2025?", "k")
    assert reply.status == 200 and reply.body["memo"]["claims"][0]["value"] == 130497.0
    assert made.ask("?", "k").status == 422 and made.ask("a question", "k").status == 429
    now[0] = 1.0
    assert made.ask("?" * 1001, "k").status == 422
    assert made.health().body == {"status": "ok", "chunks": 3, "facts": 2}


def bucket_by_hand(times, rate, capacity):
    tokens, last, out = capacity, None, []
    for now in times:
        tokens = capacity if last is None else min(capacity, tokens + (now - last) * rate)
        ok = tokens >= 1
        tokens -= ok
        last = now
        out.append(ok)
    return out


def test_token_bucket_operator(spark):
    import random

    rng = random.Random(2)
    rows, want = [], {}
    for user in range(4):
        at, times = 0.0, []
        for _ in range(150 if user == 0 else 20):
            at += rng.choice([0.25, 0.5, 1.0, 7.0])
            times.append(at)
        for i, (t, ok) in enumerate(zip(times, bucket_by_hand(times, 1.0, 3.0))):
            rows.append((user, len(rows), t))
            want[len(rows) - 1] = ok
    events = spark.createDataFrame(rows, "user int, n int, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")))
    got = {r.n: r.allowed for r in token_bucket(events, "user", "ts", "n", 1.0, 3.0).collect()}
    assert got == want and not all(want.values())
    with pytest.raises(ValueError):
        token_bucket(events, "user", "ts", "n", 0.0, 1.0)


def test_blocking_bucket():
    now, slept = [0.0], []
    bucket = remote.TokenBucket(2.0, 2.0, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    assert [bucket.try_acquire() for _ in range(3)] == [True, True, False]
    assert bucket.acquire() == pytest.approx(0.5) and slept == [pytest.approx(0.5)]
    with pytest.raises(ValueError):
        bucket.acquire(3)
    with pytest.raises(ValueError):
        remote.TokenBucket(0, 1)


def failing(*codes):
    calls = list(codes)

    def opener(url, agent, timeout):
        code = calls.pop(0)
        if code == "down":
            raise urllib.error.URLError("down")
        if code != 200:
            raise urllib.error.HTTPError(url, code, "no", {}, None)
        return b"ok"

    return opener


def test_fetch_retries():
    bucket = remote.TokenBucket(1000, 1000)
    pauses = []
    assert remote.fetch("u", "a@b", bucket, opener=failing(503, "down", 200), sleep=pauses.append) == b"ok" and pauses == [1, 2]
    with pytest.raises(remote.AccessDenied):
        remote.fetch("u", "a@b", bucket, opener=failing(403), sleep=pauses.append)
    with pytest.raises(RuntimeError, match="3 attempts"):
        remote.fetch("u", "a@b", bucket, opener=failing(429, 500, 502), sleep=pauses.append)
    with pytest.raises(urllib.error.HTTPError):
        remote.fetch("u", "a@b", bucket, opener=failing(404), sleep=pauses.append)
    for agent in ("", "  ", None, "no address"):
        with pytest.raises(ValueError):
            remote.check_user_agent(agent)


def test_archive_source(spark, tmp_path):
    urls = []
    for i in range(3):
        (tmp_path / f"{i}.htm").write_bytes(b"page %d" % i)
        urls.append(f"file://{tmp_path}/{i}.htm")
    spark.dataSource.register(remote.ArchiveSource)
    read = spark.read.format("archive").options(user_agent="T t@example.com", urls=json.dumps(urls), partitions="2", rate="100").load()
    assert sorted(bytes(r.content) for r in read.collect()) == [b"page 0", b"page 1", b"page 2"]
    manifest = spark.createDataFrame([(u, i == 2, f"p{i}") for i, u in enumerate(urls)], "url string, is_amendment boolean, local_path string")
    stored = read.filter(F.col("url") == urls[0])
    fresh = remote.download_missing(manifest, stored, "T t@example.com", slots=1, rate=100.0)
    assert [r.url for r in fresh.collect()] == [urls[1]]
    done = {r.url: (r.downloaded, r.size_bytes, r.local_path) for r in remote.record_downloads(manifest, read).collect()}
    assert done == {urls[0]: (True, 6, "p0"), urls[1]: (True, 6, "p1"), urls[2]: (False, 0, "")}


def test_embed_stream_is_resumable(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    encoder = hash_encoder(8)

    def run(checkpoint="cp"):
        docs = spark.readStream.schema("id int, text string").parquet(source)
        jobs.embed_stream(docs, encoder, target, str(tmp_path / checkpoint)).awaitTermination(120)

    spark.createDataFrame([(1, "one"), (2, "two")], "id int, text string").write.parquet(source)
    run()
    spark.createDataFrame([(2, "two"), (3, "three")], "id int, text string").write.mode("append").parquet(source)
    run()
    run("lost")  # a lost checkpoint replays everything and stores nothing twice
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_load_stream(spark, tmp_path):
    from factloom.sources.tables import create_table

    create_table(spark, "filings", FILING)
    spark.sql("SELECT 'a-1' accession_no").write.parquet(str(tmp_path / "in"))
    stored = spark.table("filings")
    rows = spark.readStream.schema("accession_no string").parquet(str(tmp_path / "in"))
    wide = rows.select(*[F.col(c) if c == "accession_no" else F.lit(None).cast(t).alias(c) for c, t in stored.dtypes])
    for checkpoint in ("a", "b"):
        jobs.load_stream(wide, "filings", str(tmp_path / checkpoint)).awaitTermination(120)
    spark.catalog.refreshTable("filings")  # a batch writes in a session of its own
    assert spark.table("filings").filter("accession_no = 'a-1'").count() == 1


def test_shed_stream(spark, tmp_path):
    rows = [("u", i, t) for i, t in enumerate((0.0, 0.1, 0.2, 0.3, 5.0))]
    df = spark.createDataFrame(rows, "user string, n int, s double").select("user", "n", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.shed_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", "ts", 1.0, 2.0)
    query = stream.writeStream.format("memory").queryName("shed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [r.allowed for r in spark.table("shed").orderBy("at_us").collect()]
    assert got == bucket_by_hand([t for _, _, t in rows], 1.0, 2.0) == [True, True, False, False, True]


def test_models_plug_in(spark, chunks, anchors):
    from factloom.plans.models import model_drafter, model_planner

    def planner(prompts):
        assert all("Allowed tickers: NVDA (NVIDIA)" in p for p in prompts)
        return [{"tickers": ["nvda", "TSLA"], "fiscal_years": [2025, 1999], "concepts": ["revenue"], "search_query": "NVIDIA revenue"} for _ in prompts]

    def drafter(prompts):
        assert all("<passage no=\"0\"" in p and "130,497.00 USD" in p for p in prompts)
        good = {"text": "Revenue was 130,497", "source_index": 0, "quote": "revenue grew to $130.5 billion", "value": 130497.0, "unit": "USD", "period": "FY2025", "concept": "revenue"}
        return [[good, {**good, "source_index": 7}, {**good, "unit": None}] for _ in prompts]

    ask = spark.createDataFrame([(1, "How much did it sell?")], "request_id int, question string")
    memo = answer(ask, chunks, anchors, planner=model_planner(planner), drafter=model_drafter(drafter)).first()
    assert len(memo.claims) == 1 and memo.claims[0].verification.verified and memo.notes == ["uncited: 2"]


def test_asks_are_answered_by_micro_batch_and_once(spark, corpus, tmp_path, monkeypatch):
    from factloom.streaming.jobs import ask_stream

    name, searches = "memo_db.memos", []
    spark.sql("CREATE DATABASE IF NOT EXISTS memo_db")
    monkeypatch.setattr(tools.Corpus, "hits", (lambda hits: lambda self, q, k: (searches.append(1), hits(self, q, k))[1])(tools.Corpus.hits))
    asked = [(f"r{i}", "What was NVDA revenue for fiscal 2025?" if i % 2 else "Which supply risks does Apple face?") for i in range(100)]
    schema = "request_id string, question string"
    spark.createDataFrame(asked + [("r1", "What was NVDA revenue for fiscal 2025?")], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    ask_stream(stream(), corpus, name, str(tmp_path / "one")).awaitTermination()
    memos = {r.request_id: r for r in spark.table(name).collect()}
    assert len(memos) == spark.table(name).count() == 100 and len(searches) == 1
    assert memos["r1"].claims[0].value == 130497.0 and memos["r2"].claims[0].citation.chunk_id == "a25:0000" and memos["r1"].trace_id != memos["r3"].trace_id
    ask_stream(stream(), corpus, name, str(tmp_path / "two")).awaitTermination()  # everything is read once more
    assert spark.table(name).count() == 100 and len(searches) == 1
    spark.sql("DROP DATABASE memo_db CASCADE")


def test_a_failed_check_says_what_the_lookup_said(spark, anchors):
    row = cl.verify(claim(spark, ticker="AAPL"), anchors).first()
    assert row.detail == "no RevenueFromContractWithCustomerExcludingAssessedTax fact for AAPL FY2025"
    assert cl.verify(claim(spark, concept="head count"), anchors).first().detail == "no concept known for this label"


def test_index_serves_searches_and_asks(spark, chunks, corpus):
    from dataclasses import replace

    from factloom.operators.lexical_index import write_index

    index = write_index(chunks, "served_index", 2, id_col="chunk_id", analyser="english")
    served = replace(corpus, index=index)
    ask = spark.createDataFrame([(1, "supply risks", ["AAPL"], []), (2, "revenue", [], [])], "query_id int, query string, tickers array<string>, fiscal_years array<int>")
    plain, indexed = (sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in tools.search(c, ask).collect()) for c in (corpus, served))
    assert plain == indexed
    made, _ = service(spark, served)
    assert made.ask("What was NVDA revenue for fiscal 2025?", "k").body["memo"]["claims"][0]["value"] == 130497.0

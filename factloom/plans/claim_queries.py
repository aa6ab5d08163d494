"""Claim queries: plans, citations, verification, contract, re-planning, prompts, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions import filings as fx
from factloom.operators import claims as cl
from factloom.operators import facts as fa
from factloom.operators.lexical import lexical_search
from factloom.operators.rate_limit import token_bucket
from factloom.plans.catalog import query, table, texts
from factloom.plans.facts_queries import FACT_CTES, _ticker, _ticker_sql, anchored, facts
from factloom.plans.retrieval_queries import arm_sql, passages

DOC_ARMS = f"WITH {arm_sql('SELECT doc_id AS id, text FROM documents')}"


@query(
    "plan_scope_clamp",
    f"""SELECT c_custkey, {_ticker_sql('c_custkey')} || ',MSFT' AS tickers, CASE WHEN c_custkey % 4 IN (1, 2) THEN 2023 + c_custkey % 4 || ',2025' ELSE '2025' END AS years,
        CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS search_query FROM customer""",
)
def plan_scope_clamp(spark, folder):
    plans = table(spark, folder, "customer").select(
        "c_custkey",
        F.array(F.lower(_ticker("c_custkey")), F.col("c_mktsegment"), F.lit("msft")).alias("tickers"),
        F.array((F.col("c_custkey") % 4 + 2023).cast("int"), F.lit(2025)).alias("fiscal_years"),
        F.col("c_name").alias("question"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("search_query"),
    )
    clamped = cl.clamp_plan(plans)
    return clamped.select(
        "c_custkey", F.array_join("tickers", ",").alias("tickers"), F.array_join(F.transform("fiscal_years", lambda y: y.cast("string")), ",").alias("years"), "search_query"
    )


def passage_hits(spark: SparkSession, folder: str, top_k: int = scope.ANSWER_TOP_K) -> DataFrame:
    """Top documents per benchmark passage, with their text."""
    docs = texts(spark, folder, "documents", "doc_id", "text")
    hits = lexical_search(docs, passages(spark, folder), top_k, id_col="doc_id", scorer="bm25")
    return docs.join(hits, "doc_id").withColumnRenamed("query_id", "request_id")


@query(
    "claim_citation_join",
    f"""{DOC_ARMS}, drafts AS (SELECT item_id, unnest(generate_series(-1, 8)) AS source_index, text AS quote FROM benchmark)
    SELECT item_id AS request_id, CAST(source_index AS INTEGER) AS source_index, coalesce(h.id, -1) AS doc_id, CAST(coalesce(contains(s.text, quote), false) AS INTEGER) AS cited
    FROM drafts LEFT JOIN bm_ranked h ON h.query_id = item_id AND h.rank - 1 = source_index AND h.rank <= 8 LEFT JOIN src s ON s.id = h.id""",
)
def claim_citation_join(spark, folder):
    """Every passage quoted from every position, positions out of range included."""
    drafts = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("request_id"), F.explode(F.sequence(F.lit(-1), F.lit(8))).alias("source_index"),
        F.concat(F.lit("  "), F.col("text"), F.lit(" ")).alias("quote"),
    )
    cited = cl.cite(drafts, passage_hits(spark, folder))
    return cited.select("request_id", "source_index", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.col("cited").cast("int").alias("cited"))


@query(
    "claim_fiscal_year",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' AND year(o_orderdate) IN (2000, 2001) THEN year(o_orderdate)
        WHEN o_orderstatus = 'O' AND year(o_orderdate) + 1 IN (2000, 2001) THEN year(o_orderdate) + 1 ELSE 1990 END AS INTEGER) AS claim_year FROM orders""",
)
def claim_fiscal_year(spark, folder):
    year = F.year("o_orderdate")
    period = F.when(F.col("o_orderstatus") == "F", F.format_string("FY%d", year)).when(
        F.col("o_orderstatus") == "O", F.format_string("no. 12%d9, then 2050 and %d", year, year + 1)
    )
    return table(spark, folder, "orders").select("o_orderkey", fx.claim_year(period, F.lit(1990), (2000, 2001)).alias("claim_year"))


def order_claims(spark: SparkSession, folder: str) -> DataFrame:
    """One claim per order: its total price, checked against the sum of its lines."""
    totals = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("expected_value"))
    priority = F.col("o_orderpriority")
    return (
        table(spark, folder, "orders")
        .join(totals, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            "o_orderkey", "o_custkey",
            F.when(priority != "5-LOW", F.col("o_totalprice")).alias("value"),
            F.when(priority != "4-NOT SPECIFIED", F.lit("total")).alias("concept"),
            "expected_value",
        )
    )


CLAIMS_SQL = """claims AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS value, o_orderpriority <> '4-NOT SPECIFIED' AS has_concept, t AS expected
    FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
judged AS (SELECT *, CASE WHEN value IS NULL THEN 'extractive' WHEN NOT has_concept OR expected IS NULL THEN 'unverified' ELSE 'xbrl' END AS method,
    CASE WHEN value IS NULL THEN true WHEN NOT has_concept OR expected IS NULL THEN false ELSE abs(value - expected) <= 0.005::DOUBLE * greatest(abs(expected), 1.0) END AS verified FROM claims)"""


@query(
    "claim_verification",
    f"""WITH {CLAIMS_SQL} SELECT o_orderkey, method, CAST(verified AS INTEGER) AS verified, CASE WHEN value IS NULL THEN 'quoted' WHEN NOT has_concept THEN 'no_concept'
        WHEN expected IS NULL THEN 'no fact found' WHEN verified THEN 'matches' ELSE format('claimed {{:,.2f}}, fact {{:,.2f}}', value, expected) END AS detail FROM judged""",
)
def claim_verification(spark, folder):
    return cl.judge(order_claims(spark, folder)).select("o_orderkey", "method", F.col("verified").cast("int").alias("verified"), "detail")


MEMO_SQL = """memos AS (SELECT o_custkey, count(value) AS n_numeric, count(*) FILTER (WHERE value IS NOT NULL AND NOT verified) AS n_unverified,
    coalesce(count(*) FILTER (WHERE value IS NOT NULL AND verified AND method = 'xbrl') / nullif(CAST(count(value) AS DOUBLE), 0), 1.0::DOUBLE) AS verified_fraction FROM judged GROUP BY o_custkey)"""


@query("verified_fraction", f"WITH {CLAIMS_SQL}, {MEMO_SQL} SELECT o_custkey, n_numeric, n_unverified, round(verified_fraction, 6) AS verified_fraction FROM memos")
def verified_fraction(spark, folder):
    memos = cl.memo_summary(cl.judge(order_claims(spark, folder)), ["o_custkey"])
    return memos.withColumn("verified_fraction", F.round("verified_fraction", 6))


@query("silent_memos", f"WITH {CLAIMS_SQL}, {MEMO_SQL} SELECT o_custkey, n_unverified FROM memos WHERE n_unverified > 0 AND o_custkey % 4 = 0")
def silent_memos(spark, folder):
    memos = cl.memo_summary(cl.judge(order_claims(spark, folder)), ["o_custkey"])
    noted = memos.withColumn("confidence_notes", F.when(F.col("o_custkey") % 4 != 0, F.lit("some figures are unverified")).otherwise(F.lit(" ")))
    return cl.silent_memos(noted).select("o_custkey", "n_unverified")


@query(
    "replan_decision",
    f"""WITH {CLAIMS_SQL}, {MEMO_SQL}, state AS (SELECT c_custkey, c_custkey % 5 AS replans, coalesce(n_numeric, 0) AS n_hits, coalesce(n_unverified, 0) AS n_unverified FROM customer LEFT JOIN memos ON o_custkey = c_custkey)
    SELECT c_custkey, CASE WHEN replans >= 3 THEN 'done' WHEN n_hits = 0 OR n_unverified > 0 THEN 'replan' ELSE 'done' END AS decision,
        CASE WHEN n_hits = 0 THEN 'no_hits' ELSE 'failed_checks: ' || n_unverified END AS reason FROM state""",
)
def replan_decision(spark, folder):
    memos = cl.memo_summary(cl.judge(order_claims(spark, folder)), ["o_custkey"])
    state = table(spark, folder, "customer").join(memos, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", (F.col("c_custkey") % 5).alias("replans"),
        F.coalesce("n_numeric", F.lit(0)).alias("n_hits"), F.coalesce("n_unverified", F.lit(0)).alias("n_unverified"),
    )
    return state.select(
        "c_custkey", cl.replan_decision(F.col("n_hits"), F.col("n_unverified"), F.col("replans")).alias("decision"),
        cl.replan_reason(F.col("n_hits"), F.col("n_unverified")).alias("reason"),
    )


CONTRACT_CASES = {
    0: "", 1: "empty text", 2: "incomplete citation", 3: "chunk outside filing", 4: "number without unit", 5: "number without period",
    6: "number judged by a model", 7: "unit without number", 8: "fact check names nothing", 9: "unverified reported as verified", 10: "unknown method",
    11: "number without unit,number without period", 12: "chunk outside filing,number judged by a model",
}


@query(
    "contract_violations",
    "SELECT o_orderkey, CASE o_orderkey % 13 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CONTRACT_CASES.items()) + " END AS violations FROM orders",
)
def contract_violations(spark, folder):
    """A well-formed claim per order, broken in a known way by key."""
    kind, key = F.col("o_orderkey") % 13, F.col("o_orderkey").cast("string")
    numeric = ~kind.isin(7)
    rules = cl.contract_violations(
        text=F.when(kind == 1, F.lit("")).otherwise(F.lit("total price")),
        value=F.when(numeric, F.col("o_totalprice")),
        unit=F.when(kind.isin(4, 11), F.lit(None).cast("string")).otherwise(F.lit("USD")),
        period=F.when(kind.isin(5, 11), F.lit("")).otherwise(F.year("o_orderdate").cast("string")),
        method=F.when(kind.isin(6, 12), F.lit("judged")).when(kind == 9, F.lit("unverified")).when(kind == 10, F.lit("guess")).otherwise(F.lit("xbrl")),
        verified=F.lit(True),
        checked_concept=F.when(kind != 8, F.lit("total")),
        period_end=F.to_date("o_orderdate"),
        accession_no=key,
        section=F.lit("MDA"),
        chunk_id=F.concat(F.when(kind.isin(3, 12), F.lit("x")).otherwise(F.lit("")), key, F.lit(":0001")),
        quote=F.when(kind == 2, F.lit("")).otherwise(F.lit("q")),
    )
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(rules, ",").alias("violations"))


@query(
    "prompt_render",
    f"""{DOC_ARMS} SELECT query_id AS request_id, string_agg('<passage no="' || (rank - 1) || '" from="' || concat_ws(' / ', d.source, '2024', d.lang) || '">' || chr(10) || d.text
        || chr(10) || '</passage>', chr(10) || chr(10) ORDER BY rank) AS excerpts FROM bm_ranked JOIN documents d ON d.doc_id = id WHERE rank <= 3 GROUP BY query_id""",
)
def prompt_render(spark, folder):
    meta = table(spark, folder, "documents").select("doc_id", F.col("source").alias("ticker"), F.col("lang").alias("item_section"))
    hits = passage_hits(spark, folder, 3).join(meta, "doc_id").withColumn("fiscal_year", F.lit(2024))
    return cl.render_excerpts(hits, ["request_id"])


@query(
    "prompt_facts",
    f"""WITH {FACT_CTES}, asked AS (SELECT {_ticker_sql('n_nationkey')} AS ticker, unnest([1996, 1997, 2003]) AS fiscal_year, n_name FROM nation),
    wanted AS (SELECT asked.*, unnest(['Assets', 'NetIncomeLoss']) AS concept FROM asked)
    SELECT n_name AS request_id, string_agg(CASE WHEN a.value IS NULL THEN w.ticker || ' ' || w.concept || ' = none (no ' || w.concept || ' fact for ' || w.ticker || ' FY' || w.fiscal_year || ')'
        ELSE w.ticker || ' ' || w.concept || ' = ' || format('{{:,.2f}}', a.value) || ' ' || a.unit || ' (to ' || a.period_end || ', ' || a.accession_no || ')' END,
        chr(10) ORDER BY w.ticker, w.fiscal_year, w.concept) AS facts
    FROM wanted w LEFT JOIN anchored a ON a.ticker = w.ticker AND a.concept = w.concept AND a.fiscal_year = w.fiscal_year GROUP BY n_name""",
)
def prompt_facts(spark, folder):
    plans = table(spark, folder, "nation").select(
        F.col("n_name").alias("request_id"), F.array(_ticker("n_nationkey")).alias("tickers"),
        F.array(*[F.lit(y) for y in (1996, 1997, 2003)]).alias("fiscal_years"), F.array(F.lit("assets"), F.lit("net income")).alias("concepts"),
    )
    found = fa.explain_misses(fa.lookup(fa.enumerate_lookups(plans), anchored(spark, folder)), facts(spark, folder))
    return cl.render_facts(found, ["request_id"])


BUCKET_RATE, BUCKET_BURST = 1 / 43200, 3.0


@query(
    "token_bucket_shedding",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    b AS (SELECT user_id, event_id, rn, us, true AS allowed, 2.0::DOUBLE AS tokens FROM e WHERE rn = 1
        UNION ALL SELECT user_id, event_id, rn, us, filled >= 1.0, CASE WHEN filled >= 1.0 THEN filled - 1.0 ELSE filled END FROM (
            SELECT e.user_id, e.event_id, e.rn, e.us, least(3.0::DOUBLE, b.tokens + CAST(e.us - b.us AS DOUBLE) / 1e6 * (1.0::DOUBLE / 43200.0::DOUBLE)) AS filled FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1))
    SELECT user_id, event_id, CAST(allowed AS INTEGER) AS allowed, round(tokens, 6) AS tokens_left FROM b""",
)
def token_bucket_shedding(spark, folder):
    """One request per half day on average, bursts of three."""
    decided = token_bucket(table(spark, folder, "events"), "user_id", "ts", "event_id", BUCKET_RATE, BUCKET_BURST)
    return decided.select("user_id", "event_id", F.col("allowed").cast("int").alias("allowed"), F.round("tokens_left", 6).alias("tokens_left"))


# --- questions answered end to end ---------------------------------------------------------------------

def filing_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of documents with filing metadata: the source gives the filer, the key the year."""
    from factloom.plans.document_queries import chunked

    docs = table(spark, folder, "documents").select(
        "doc_id", F.get(F.array(*[F.lit(t) for t in scope.TICKERS]), F.substring("source", 4, 3).cast("int") % len(scope.TICKERS)).alias("ticker"),
        (F.col("doc_id") % 2 + 1996).cast("int").alias("fiscal_year"),
    )
    return chunked(spark, folder).join(docs, "doc_id").select(
        "chunk_id", F.col("doc_id").cast("string").alias("accession_no"), "ticker", "fiscal_year", "item_section", "text"
    )


def nation_questions(spark: SparkSession, folder: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("net income"), F.lit("total assets"), F.lit("head count")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("request_id"),
        F.format_string("Within what filings did %s report %s for fiscal year %d? The and of.", _ticker("n_nationkey"), label, F.col("n_nationkey") % 2 + 1996).alias("question"),
    )


ASKED_SQL = f"""asked AS (SELECT n_nationkey, {_ticker_sql('n_nationkey')} AS ticker, 1996 + n_nationkey % 2 AS fy, CASE WHEN n_nationkey % 3 = 0 THEN 'net income' WHEN n_nationkey % 3 = 1 THEN 'total assets' ELSE 'head count' END AS label,
            CASE WHEN n_nationkey % 3 = 0 THEN 'NetIncomeLoss' WHEN n_nationkey % 3 = 1 THEN 'Assets' END AS concept FROM nation),
    found AS (SELECT a.*, f.value, f.unit FROM asked a LEFT JOIN anchored f ON f.ticker = a.ticker AND f.concept = a.concept AND f.fiscal_year = a.fy)"""


@query(
    "answer_memos",
    f"""WITH {FACT_CTES}, asked AS (SELECT n_nationkey, {_ticker_sql('n_nationkey')} AS ticker, 1996 + n_nationkey % 2 AS fy, CASE WHEN n_nationkey % 3 = 0 THEN 'net income' WHEN n_nationkey % 3 = 1 THEN 'total assets' ELSE 'head count' END AS label,
            CASE WHEN n_nationkey % 3 = 0 THEN 'NetIncomeLoss' WHEN n_nationkey % 3 = 1 THEN 'Assets' END AS concept FROM nation),
    found AS (SELECT a.*, f.value, f.unit FROM asked a LEFT JOIN anchored f ON f.ticker = a.ticker AND f.concept = a.concept AND f.fiscal_year = a.fy)
    SELECT n_nationkey AS request_id, CASE WHEN value IS NULL THEN 'Within what filings did ' || ticker || ' report ' || label || ' for fiscal year ' || fy || '? The and of.'
            ELSE ticker || ' ' || label || ' for fiscal year ' || fy || ' was ' || format('{{:,.2f}}', value) || ' ' || unit END AS answer_summary,
        0 AS replans, CAST(value IS NOT NULL AS INTEGER) AS n_numeric, 0 AS n_unverified, 1.0::DOUBLE AS verified_fraction FROM found""",
)
def answer_memos(spark, folder):
    """A question per nation about a figure of its filer, through the whole loop."""
    from factloom.plans.answering import answer

    memos = answer(nation_questions(spark, folder), filing_chunks(spark, folder), anchored(spark, folder), years=(1996, 1997))
    return memos.select("request_id", "answer_summary", "replans", "n_numeric", "n_unverified", "verified_fraction")


@query(
    "answer_memos_replanned",
    f"""WITH {FACT_CTES}, {ASKED_SQL}
    SELECT n_nationkey AS request_id, CASE WHEN value <> 0 AND n_nationkey % 2 = 0 THEN 3 ELSE 0 END AS replans, CAST(value IS NOT NULL AS INTEGER) AS n_numeric,
        CAST(coalesce(value <> 0 AND n_nationkey % 2 = 0, false) AS INTEGER) AS n_unverified, CASE WHEN value <> 0 AND n_nationkey % 2 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS verified_fraction,
        coalesce(value <> 0 AND n_nationkey % 2 = 0, false) AS disclosed FROM found""",
)
def answer_memos_replanned(spark, folder):
    """The same questions with a drafter that doubles the figures of every other request: those are re-planned until the bound and say so."""
    from factloom.plans.answering import answer, extractive_drafter

    def misstating(plans, hits, facts):
        drafts = extractive_drafter(plans, hits, facts)
        return drafts.withColumn("value", F.when(F.col("request_id") % 2 == 0, F.col("value") * 2).otherwise(F.col("value")))

    memos = answer(nation_questions(spark, folder), filing_chunks(spark, folder), anchored(spark, folder), drafter=misstating, years=(1996, 1997))
    return memos.select("request_id", "replans", "n_numeric", "n_unverified", "verified_fraction", (F.col("confidence_notes") != "").alias("disclosed"))

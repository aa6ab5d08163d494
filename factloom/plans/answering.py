"""Answering questions: plan, retrieve, look up, draft, verify, and re-plan what failed.

All open requests move through each round together. A round's outcome is checkpointed, and only
the requests that must be re-planned enter the next one; three re-plans end the loop.

Planner and drafter are functions on DataFrames. The defaults work offline: a dictionary planner
and an extractive drafter. Neither writes citations; a draft only names the position of a hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import scope
from factloom.operators import claims as cl
from factloom.operators import facts as fa
from factloom.operators.lexical import lexical_search
from factloom.session import cut_lineage, shared_folder

Planner = Callable[[DataFrame], DataFrame]
Drafter = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def dictionary_planner(years=scope.FISCAL_YEARS) -> Planner:
    """Tickers, company names, years and labels named in the question. The first re-plan drops
    the year filter, the second one the ticker filter of the text search."""
    names = F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(n).alias("name")) for t, n in scope.COMPANY_NAMES.items()])
    labels = F.array(*[F.lit(x) for x in (*scope.LABEL_TO_CONCEPT, *scope.REVENUE_LABELS)])

    def plan(requests: DataFrame) -> DataFrame:
        question = F.col("question")
        padded = F.concat(F.lit(" "), F.regexp_replace(question, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
        lowered = F.replace(F.lower(question), F.lit("'"), F.lit(""))
        named = F.filter(
            names, lambda n: padded.contains(F.concat(F.lit(" "), n["ticker"], F.lit(" "))) | padded.contains(n["name"])
        )
        mentioned = F.filter(labels, lambda x: lowered.contains(x))
        longest = F.filter(mentioned, lambda x: ~F.exists(mentioned, lambda y: (y != x) & y.contains(x)))
        return requests.select(
            "*",
            F.transform(named, lambda n: n["ticker"]).alias("tickers"),
            F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(r"(?<!\d)\d{4}(?!\d)"), F.lit(0)), lambda y: y.cast("int"))).alias("fiscal_years"),
            longest.alias("concepts"),
            F.array_join(F.concat(F.array(question), F.transform(named, lambda n: n["name"])), " ").alias("search_query"),
        )

    return plan


def search_scope(plans: DataFrame) -> DataFrame:
    """Retrieval queries of a round, with filters widened as re-plans go on."""
    none_s, none_i = F.array().cast("array<string>"), F.array().cast("array<int>")
    return plans.select(
        F.col("request_id").alias("query_id"), F.col("search_query").alias("query"),
        F.when(F.col("replans") < 2, F.col("tickers")).otherwise(none_s).alias("tickers"),
        F.when(F.col("replans") < 1, F.col("fiscal_years")).otherwise(none_i).alias("fiscal_years"),
    )


def extractive_drafter(plans: DataFrame, hits: DataFrame, facts: DataFrame) -> DataFrame:
    """One numeric claim per fact found, else one prose claim, each quoting the first line of the
    best hit. (request_id, text, source_index, quote, value, unit, period, concept)"""
    best = hits.filter("rank = 1").select("request_id", F.split("text", "\n")[0].alias("quote"))
    found = facts.filter("found").select(
        "request_id",
        F.format_string("%s %s for fiscal year %d was %,.2f %s", "ticker", "label", "fiscal_year", "value", "unit").alias("text"),
        "value", "unit", F.format_string("FY%d", "fiscal_year").alias("period"), F.col("label").alias("concept"),
    )
    joined = plans.select("request_id", "question").join(best, "request_id").join(found, "request_id", "left")
    return joined.select(
        "request_id", F.coalesce("text", F.col("question")).alias("text"), F.lit(0).alias("source_index"), "quote",
        "value", "unit", "period", "concept",
    )


def _claim_struct() -> Column:
    return F.struct(
        "text", "value", "unit", "period",
        F.struct("accession_no", "item_section", "chunk_id", F.col("quote").alias("quote_span")).alias("citation"),
        F.struct(
            "method", "verified", F.col("checked_concept").alias("concept"), F.col("checked_period_end").alias("period_end"),
            "expected_value", "detail",
        ).alias("verification"),
    )


def build_claims(drafts: DataFrame, hits: DataFrame, anchors: DataFrame, years) -> DataFrame:
    """Cited, verified claims; `kept` is false for what must be dropped."""
    cited = cl.cite(drafts.withColumnRenamed("text", "claim_text"), hits)
    checked = cl.verify(cited, anchors, years).drop("text").withColumnRenamed("claim_text", "text")
    broken = cl.contract_violations(
        *[F.col(c) for c in ("text", "value", "unit", "period", "method", "verified", "checked_concept", "checked_period_end",
                             "accession_no", "item_section", "chunk_id", "quote")]
    )
    return checked.withColumn("kept", F.col("cited") & (F.size(broken) == 0))


def _round(requests: DataFrame, chunks: DataFrame, anchors: DataFrame, planner: Planner, drafter: Drafter, search, years, top_k: int) -> DataFrame:
    plans = cl.clamp_plan(planner(requests), tickers=tuple(scope.COMPANY_NAMES), years=years)
    found = search(chunks, search_scope(plans), top_k)
    # A few hits per request, read by the drafter, the citation join and the count.
    hits = cut_lineage(chunks.join(found, "chunk_id").withColumnRenamed("query_id", "request_id"))
    facts = fa.lookup(fa.enumerate_lookups(plans, years), anchors)
    claims = build_claims(drafter(plans, hits, facts), hits, anchors, years)
    # A request drafts at most one claim per looked-up fact, so its claims stay a short list.
    memo = claims.groupBy("request_id").agg(
        F.collect_list(F.when(F.col("kept"), _claim_struct())).alias("claims"),
        F.count_if(~F.col("kept")).alias("dropped"),
    )
    n_hits = hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_hits"))
    numeric = F.filter("claims", lambda c: c["value"].isNotNull())
    failed = F.filter(numeric, lambda c: ~c["verification"]["verified"])
    passed = F.filter(numeric, lambda c: c["verification"]["verified"] & (c["verification"]["method"] == "xbrl"))
    state = (
        plans.join(n_hits, "request_id", "left").join(memo, "request_id", "left")
        .withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
        .withColumn("n_unverified", F.greatest(F.size(failed), F.lit(0)))
        .withColumn("n_numeric", F.greatest(F.size(numeric), F.lit(0)))
        .withColumn("n_claims", F.greatest(F.size("claims"), F.lit(0)))
        .withColumn("verified_fraction", F.coalesce(F.try_divide(F.size(passed), F.nullif(F.size(numeric), F.lit(0))), F.lit(1.0)))
    )
    return state.withColumn(
        "decision", cl.replan_decision(F.col("n_hits"), F.col("n_unverified"), F.col("replans"))
    ).withColumn(
        "notes",
        F.concat(
            "notes",
            F.when(F.coalesce("dropped", F.lit(0)) > 0, F.array(F.format_string("uncited: %d", "dropped"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("decision") == "replan", F.array(cl.replan_reason(F.col("n_hits"), F.col("n_unverified")))).otherwise(F.array().cast("array<string>")),
        ),
    )


def default_search(chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    return lexical_search(chunks, queries, top_k, id_col="chunk_id", scorer="bm25")


def answer(requests: DataFrame, chunks: DataFrame, anchors: DataFrame, *, planner: Planner | None = None, drafter: Drafter = extractive_drafter,
           search=default_search, years=scope.FISCAL_YEARS, top_k: int = scope.ANSWER_TOP_K, max_replans: int = scope.MAX_REPLANS) -> DataFrame:
    """Memos for (request_id, question): claims with citation and verification, confidence notes,
    number of re-plans, share of verified numbers.

    chunks: chunk_id, accession_no, ticker, fiscal_year, item_section, text; anchors: the output
    of `facts.anchored`."""
    planner = planner or dictionary_planner(years)
    # Every round searches the chunks and picks up the texts of its hits: they are made once.
    path = f"{shared_folder(chunks.sparkSession)}/chunks-{uuid.uuid4().hex}"
    chunks.write.parquet(path)
    chunks = chunks.sparkSession.read.schema(chunks.schema).parquet(path)
    anchors = cut_lineage(anchors)  # one row a filer, concept and year, read twice a round
    todo = requests.select("request_id", "question", F.lit(0).alias("replans"), F.array().cast("array<string>").alias("notes"))
    finished = None
    for _ in range(max_replans + 1):
        outcome = cut_lineage(_round(todo, chunks, anchors, planner, drafter, search, years, top_k))
        done = outcome.filter("decision = 'done'")
        finished = done if finished is None else finished.unionByName(done)
        again = outcome.filter("decision = 'replan'")
        if again.isEmpty():
            break
        todo = again.select("request_id", "question", (F.col("replans") + 1).alias("replans"), "notes")
    caveat = F.when(F.col("n_unverified") > 0, F.lit("Check the figures marked unverified.")).otherwise(F.lit(""))
    summary = F.when(F.col("n_claims") > 0, F.array_join(F.transform("claims", lambda c: c["text"]), "; ")).otherwise(
        F.lit("(no claims)")
    )
    # One name for a request's run, the same whenever it is computed.
    trace = F.md5(F.concat_ws("/", F.col("request_id").cast("string"), "question"))
    return finished.select(
        "request_id", trace.alias("trace_id"), "question", summary.alias("answer_summary"), "claims",
        caveat.alias("confidence_notes"), "replans", "n_hits", "n_numeric", "n_unverified", "verified_fraction", "notes",
    )

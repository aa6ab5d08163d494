"""Tools over a corpus: search, fact lookup, calculator, scope. One body for every caller.

`register_sql` offers the same tools as SQL functions, so a SQL client can join against them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions.calculator import calculate, evaluate
from factloom.functions.filings import concept_of
from factloom.operators import facts as fa
from factloom.operators.embedding import Encoder
from factloom.operators.fusion import IndexSearch, retrieve
from factloom.operators.lexical_index import LexicalIndex, search_index

MAX_TOP_K = 50

DESCRIPTIONS = {
    "search_filings": "Passages of annual and quarterly reports for a query, each with what is needed to cite it. Name companies as their filings do.",
    "lookup_financial_fact": "A reported figure for a filer, a plain label or concept, and a fiscal year. Reported figures outrank numbers found in text.",
    "calculate": "The value of an arithmetic expression, so that no figure is worked out by hand.",
}
DISCLAIMER = "Research aid over public filings, not investment advice. Figures that could not be verified are named in confidence_notes."


@dataclass
class Corpus:
    """What the tools read. chunks: chunk_id, accession_no, ticker, fiscal_year, item_section, text;
    vectors: chunk_id, ticker, fiscal_year, embedding; facts and anchors from the fact operators."""

    chunks: DataFrame
    vectors: DataFrame
    facts: DataFrame
    anchors: DataFrame
    encoder: Encoder | None = None
    scorer: str = "cover_density"
    analyser: str = "english"
    index: LexicalIndex | None = None

    def index_search(self) -> IndexSearch | None:
        """Lexical search of the stored index, where there is one; the analyser is then the index's own."""
        if self.index is None:
            return None
        return lambda queries, top_k: search_index(queries.sparkSession, self.index, queries, top_k, scorer=self.scorer)

    def hits(self, queries: DataFrame, top_k: int) -> DataFrame:
        """Retrieval for (query_id, query[, tickers, fiscal_years]); hybrid where an encoder is at hand."""
        vector = self.encoder(F.col("query")) if self.encoder else F.lit(None).cast("array<double>")
        return retrieve(
            self.chunks, self.vectors, queries.withColumn("vector", vector), top_k, id_col="chunk_id", scorer=self.scorer, analyser=self.analyser, index_search=self.index_search(),
        )


def answer_search(corpus: Corpus) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """The corpus's retrieval as the answer loop calls it."""
    return lambda chunks, queries, top_k: corpus.hits(queries, top_k).drop("mode")


def search(corpus: Corpus, requests: DataFrame, top_k: int = 5) -> DataFrame:
    """Hits for (query_id, query[, tickers, fiscal_years]); hybrid where an encoder is at hand."""
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must lie in 1..{MAX_TOP_K}")
    blank = F.btrim(F.coalesce("query", F.lit(""))) == ""
    checked = F.when(blank, F.raise_error(F.lit("a search needs a query"))).otherwise(F.col("query"))
    hits = corpus.hits(requests.withColumn("query", checked), top_k)
    placed = corpus.chunks.join(hits, "chunk_id")
    return placed.withColumn("citation", F.concat_ws("#", "accession_no", "item_section", "chunk_id"))


def lookup(corpus: Corpus, requests: DataFrame) -> DataFrame:
    """Facts for (ticker, label, fiscal_year); a miss says why and lists what the filer reports."""
    asked = requests.withColumn("ticker", F.upper("ticker")).withColumn("concept", concept_of(F.col("ticker"), F.col("label")))
    return fa.explain_misses(fa.lookup(asked, corpus.anchors), corpus.facts)


def calculate_json(expression: str) -> str:
    """Result or error as JSON; a bad expression is an answer, not a failure."""
    value, problem = calculate(expression)
    body = {"expression": expression, "value": value} if problem is None else {"error": problem, "expression": expression}
    return json.dumps(body, indent=2)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def corpus_scope() -> dict:
    return {
        "tickers": list(scope.COMPANY_NAMES),
        "fiscal_years": list(scope.FISCAL_YEARS),
        "forms": list(scope.PERIODIC_FORMS),
        "note": DISCLAIMER,
    }


def register_sql(spark: SparkSession, corpus: Corpus) -> None:
    """SQL functions `calculate`, `lookup_fact` and `search_documents` for this session.

    The table functions are plain SQL, so the optimizer inlines them and pushes their arguments
    down. `search_documents` ranks by cover density without stemming."""
    corpus.anchors.createOrReplaceTempView("tool_anchors")
    corpus.chunks.createOrReplaceTempView("tool_chunks")
    spark.udf.register("calculate", evaluate)
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION lookup_fact(wanted_ticker STRING, wanted_concept STRING, wanted_year INT)
        RETURNS TABLE (ticker STRING, concept STRING, fiscal_year INT, value DOUBLE, unit STRING, period_end DATE, accession_no STRING)
        RETURN SELECT ticker, concept, fiscal_year, value, unit, period_end, accession_no FROM tool_anchors
        WHERE ticker = upper(wanted_ticker) AND concept = wanted_concept AND fiscal_year = wanted_year"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION search_documents(wanted STRING, top_k INT)
        RETURNS TABLE (place INT, chunk_id STRING, accession_no STRING, item_section STRING, score DOUBLE)
        RETURN SELECT place, chunk_id, accession_no, item_section, score FROM (
            SELECT row_number() OVER (ORDER BY score DESC, chunk_id) AS place, * FROM (
                SELECT chunk_id, accession_no, item_section, count(*) * {scope.COVER_WEIGHT}D AS score
                FROM (SELECT chunk_id, accession_no, item_section, explode(regexp_extract_all(lower(text), '\\\\p{{L}}+', 0)) AS term FROM tool_chunks)
                WHERE array_contains(regexp_extract_all(lower(wanted), '\\\\p{{L}}+', 0), term) GROUP BY ALL)) WHERE place <= top_k"""
    )

"""The four retrieval arms, scored side by side for all cases at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions.filings import mapped
from factloom.operators import metrics
from factloom.operators.dense import dense_search
from factloom.operators.fusion import overlap_score, reciprocal_rank_fusion, rerank
from factloom.operators.gates import union_all
from factloom.operators.lexical import lexical_search
from factloom.operators.questions import case_query, round_robin
from factloom.operators.sections import sections_in
from factloom.session import cut_lineage


def arms(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = scope.EVAL_K, *, id_col: str = "chunk_id",
         analyser: str = "plain", scorer: str = "cover_density", reranker=overlap_score) -> dict[str, DataFrame]:
    """Hits per arm. No metadata filter on any arm; the reranker sees five times k fused hits.

    Both retrievers run once, at the greatest depth any arm needs. Their ranked lists are small
    and totally ordered, so every arm is a prefix or a fusion of prefixes of the same two lists."""
    wide = k * scope.CANDIDATE_MULTIPLIER
    deep = wide * scope.CANDIDATE_MULTIPLIER
    lexical = cut_lineage(lexical_search(chunks, queries, deep, id_col=id_col, scorer=scorer, analyser=analyser))
    dense = cut_lineage(dense_search(vectors, queries, deep, id_col=id_col))

    def best(hits: DataFrame, n: int) -> DataFrame:
        return hits.filter(F.col("rank") <= n)

    def fused(n: int) -> DataFrame:
        depth = n * scope.CANDIDATE_MULTIPLIER
        return reciprocal_rank_fusion([best(lexical, depth), best(dense, depth)], n, id_col=id_col)

    return {
        "lexical": best(lexical, k),
        "dense": best(dense, k),
        "hybrid": fused(k),
        "hybrid + rerank": rerank(fused(wide), chunks, queries, k, id_col=id_col, scorer=reranker),
    }


def evaluate(hits_by_arm: dict[str, DataFrame], labels: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = scope.EVAL_K,
             id_col: str = "chunk_id") -> DataFrame:
    """config, n_cases, recall_at_k, mrr, k. labels: (chunk_id, accession_no, item_section).

    All arms are scored in one pass over labels and relevance."""
    hits = union_all([h.select(F.lit(name).alias("config"), "query_id", "rank", id_col) for name, h in hits_by_arm.items()])
    cases = queries.select("query_id", F.explode(F.array(*[F.lit(name) for name in hits_by_arm])).alias("config"))
    scores = metrics.case_scores(hits.join(labels, id_col), relevant, cases, k, by=("config", "query_id"))
    return metrics.summary(scores, k=k)


def build_cases(filings: DataFrame, target: int = scope.TARGET_CASES) -> DataFrame:
    """Labelled cases from extracted filings (accession_no, ticker, form_type, fiscal_year, text):
    one per annual report and substantive section, drawn evenly over the filers.

    Queries use the company's name and wording of their own, so that no retriever is favoured by
    words copied from the section it should find. Sections known to be stubs are left out."""
    lines = F.split("text", "\n")
    found = filings.filter("form_type = '10-K'").select(
        "ticker", "fiscal_year", "accession_no", F.inline(sections_in(lines, F.col("form_type")))
    )
    stubs = [f"{t}/{s}" for t, names in scope.STUB_ALLOWLIST.items() for s in names]
    candidates = found.filter(
        (F.col("end_line") - F.col("start_line") >= scope.MIN_SECTION_LINES) & ~F.concat_ws("/", "ticker", "name").isin(*stubs)
    ).select("ticker", F.col("name").alias("section"), "fiscal_year", "accession_no")
    drawn = round_robin(candidates, "ticker", "section", ["fiscal_year", "accession_no"], target=target)
    name = F.coalesce(mapped(scope.COMPANY_NAMES, F.col("ticker")), F.col("ticker"))
    return drawn.select(
        F.format_string("r-%03d-%s-%s-%d", "case_no", "ticker", "section", "fiscal_year").alias("query_id"),
        case_query(F.col("section"), name, F.col("fiscal_year"), F.col("case_no")).alias("query"),
        F.array(F.struct("accession_no", F.col("section").alias("item_section"))).alias("relevant"),
        F.array("ticker").alias("tickers"),
        F.array("fiscal_year").alias("fiscal_years"),
    )

"""Rank fusion, hybrid search and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions.numeric import rounded
from factloom.functions.text import words
from factloom.operators.dense import dense_search
from factloom.operators.gates import union_all
from factloom.operators.lexical import lexical_search
from factloom.operators.ranking import top_hits
from factloom.operators.scan import per_key_top
from factloom.session import cut_lineage


def reciprocal_rank_fusion(rankings: list[DataFrame], top_k: int = scope.DEFAULT_TOP_K, k: int = scope.RRF_K, id_col: str = "id") -> DataFrame:
    """Sum 1/(k + rank) over the lists. Inputs hold at most `depth` rows per query, so this
    aggregation is small whatever the corpus size."""
    merged = union_all([r.select("query_id", id_col, "rank") for r in rankings])
    fused = merged.groupBy("query_id", id_col).agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("score"))
    return top_hits(fused, top_k, id_col)


# (queries, top_k) -> query_id, rank, id, score, from a stored index.
IndexSearch = Callable[[DataFrame, int], DataFrame]


def _lexical(docs: DataFrame, queries: DataFrame, top_k: int, id_col: str, index_search: IndexSearch | None, **options) -> DataFrame:
    return lexical_search(docs, queries, top_k, id_col=id_col, **options) if index_search is None else index_search(queries, top_k)


def hybrid_search(docs: DataFrame, corpus: DataFrame, queries: DataFrame, top_k: int = scope.DEFAULT_TOP_K, *, id_col: str = "id",
                  scorer: str = "cover_density", analyser: str = "plain", index_search: IndexSearch | None = None, **filters) -> DataFrame:
    """Both arms, five times deeper than the answer, fused. queries: query_id, query, vector.

    With ``index_search`` the lexical arm is that search, and the texts of ``docs`` are not read."""
    depth = top_k * scope.CANDIDATE_MULTIPLIER
    return _fused(_lexical(docs, queries, depth, id_col, index_search, scorer=scorer, analyser=analyser, **filters), corpus, queries, top_k, id_col, **filters)


def _fused(lexical: DataFrame, corpus: DataFrame, queries: DataFrame, top_k: int, id_col: str, **filters) -> DataFrame:
    dense = dense_search(corpus, queries, top_k * scope.CANDIDATE_MULTIPLIER, id_col=id_col, **filters)
    return reciprocal_rank_fusion([lexical, dense], top_k, id_col=id_col)


def retrieve(docs: DataFrame, corpus: DataFrame, queries: DataFrame, top_k: int, *, id_col: str = "id", index_search: IndexSearch | None = None, **options) -> DataFrame:
    """Hybrid for queries that carry a vector, lexical alone for those that do not."""
    # One lexical search for both, as deep as the fusion needs; its lists are small and read twice.
    lists = {k: options.pop(k) for k in ("scorer", "analyser") if k in options}
    deep = cut_lineage(_lexical(docs, queries, top_k * scope.CANDIDATE_MULTIPLIER, id_col, index_search, **lists, **options))
    fused = queries.filter("vector is not null")
    lexical = deep.join(queries.filter("vector is null").select("query_id"), "query_id", "left_semi").filter(F.col("rank") <= top_k)
    hybrid = _fused(deep.join(fused.select("query_id"), "query_id", "left_semi"), corpus, fused, top_k, id_col, **options)
    return lexical.withColumn("mode", F.lit("lexical")).unionByName(hybrid.withColumn("mode", F.lit("hybrid")))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that occur in the text."""
    asked = F.array_distinct(words(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, words(text))), F.size(asked)), F.lit(0.0))


def rerank(shortlist: DataFrame, docs: DataFrame, queries: DataFrame, top_k: int = scope.DEFAULT_TOP_K, *, id_col: str = "id",
           scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """Score (query, text) pairs of the shortlist only; ties keep the earlier rank.

    The shortlist is small and read twice, so it is cut from the search that made it; the
    semi-join on its ids then meets the document scan first."""
    shortlist = cut_lineage(shortlist)
    texts = docs.join(shortlist.select(id_col).distinct(), id_col, "left_semi").select(id_col, "text")
    pairs = shortlist.join(texts, id_col).join(queries.select("query_id", "query"), "query_id")
    scored = pairs.withColumn("score", rounded(scorer(F.col("query"), F.col("text")), 9)).withColumnRenamed("rank", "rank_in")
    ranked = per_key_top(scored, ["query_id"], [F.desc("score"), F.asc("rank_in")], top_k)
    return ranked.select("query_id", "rank", id_col, "score")

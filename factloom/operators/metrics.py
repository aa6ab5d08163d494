"""Retrieval quality: recall at k and mean reciprocal rank, for all cases in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import scope


def case_scores(hits: DataFrame, relevant: DataFrame, cases: DataFrame, k: int = scope.EVAL_K, keys=("accession_no", "item_section"),
                by=("query_id",)) -> DataFrame:
    """query_id, recall, reciprocal_rank for every case, found or not. With `by`, cases and hits may
    carry more keys than the query, such as the retrieval arm.

    hits: query_id, rank, *keys; relevant: query_id, *keys. Relevance is counted per section, so
    several chunks of one section count once."""
    wanted = relevant.select("query_id", *keys).distinct()
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    matched = hits.join(wanted, ["query_id", *keys])
    found = matched.groupBy(*by).agg(
        F.countDistinct(F.when(F.col("rank") <= k, F.struct(*keys))).alias("n_found"),
        F.min("rank").alias("first_rank"),
    )
    return (
        cases.select(*by)
        .join(sizes, "query_id", "left")
        .join(found, list(by), "left")
        .select(
            *by,
            F.coalesce(F.try_divide(F.col("n_found"), F.col("n_relevant")), F.lit(0.0)).alias("recall"),
            F.coalesce(F.try_divide(F.lit(1.0), F.col("first_rank")), F.lit(0.0)).alias("reciprocal_rank"),
        )
    )


def summary(scores: DataFrame, config: str | None = None, k: int = scope.EVAL_K) -> DataFrame:
    """config, n_cases, recall_at_k, mrr, k; one row per value of `config` in the scores, or one
    row for all of them under the given name."""
    named = scores if config is None else scores.withColumn("config", F.lit(config))
    return named.groupBy("config").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.round(F.avg("recall"), 6).alias("recall_at_k"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.lit(k).alias("k"),
    )


def report_lines(summaries: DataFrame) -> DataFrame:
    text = F.format_string("%-22s%10.3f%10.3f%8d", "config", "recall_at_k", "mrr", "n_cases")
    return summaries.select("config", text.alias("line"))

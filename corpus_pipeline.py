"""Corpus pipeline over ``documents``: keep known languages, one of each group of near copies, no contaminated document; mix sources; write token blocks.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language, mixing, ngram_join, token_blocks
from factloom.llm.common import stored, unsigned_crc32

NEAR_COPY = ngram_join.Rule(words=5, num=8, den=10)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject. It learns from the labelled three quarters of the stage's input.

    Where nothing is labelled no language can be told from another: all documents with letters are kept."""
    learned = docs.where(F.coalesce(unsigned_crc32(F.col("doc_id")) % 4 != 2, F.lit(False)))
    model = language.learn(learned)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    guessed = language.predict(docs, model, out="_guess")
    return guessed.where(~F.col("_guess.rejected")).drop("_guess")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, the one with the smallest id."""
    return ngram_join.keep_one(docs, NEAR_COPY)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.remove(decontaminate.find_windows(docs, benchmark, out="_found"), out="_found")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's target weight wants."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents in binary blocks; one row per document, read back from them."""
    import public_tokenizers

    path = token_blocks.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_blocks.read(spark, path)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_output),
]
ORACLE_SQL = None  # tokens, trained predictions and components are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs

"""File sources and sinks: manifests, question sets, retrieval cases, HTML pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.model import MANIFEST, QUESTION, RETRIEVAL_CASE


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """JSON lines, sorted by ticker, report date and form across the output files."""
    manifest.orderBy("ticker", "report_date", "form").write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files hold a number or a text as the expected value; both get their column."""
    loose = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "expected_value" else f for f in QUESTION.fields if f.name != "expected_text"])
    raw = spark.read.schema(loose).json(path)
    number = F.col("expected_value").try_cast("double")
    return raw.withColumn("expected_text", F.when(number.isNull(), F.col("expected_value"))).withColumn(
        "expected_value", number
    ).select(*QUESTION.fieldNames())


def write_questions(questions: DataFrame, path: str) -> None:
    questions.orderBy("question_id").write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases as (query_id, query, tickers, fiscal_years, relevant pairs)."""
    raw = spark.read.schema(RETRIEVAL_CASE).json(path)
    pairs = F.transform("relevant", lambda r: F.struct(r[0].alias("accession_no"), r[1].alias("item_section")))
    return raw.select(F.col("case_id").alias("query_id"), "query", pairs.alias("relevant"), "tickers", "fiscal_years")


def write_cases(cases: DataFrame, path: str) -> None:
    pairs = F.transform("relevant", lambda r: F.array(r["accession_no"], r["item_section"]))
    out = cases.select(F.col("query_id").alias("case_id"), "query", pairs.alias("relevant"), "tickers", "fiscal_years")
    out.orderBy("case_id").write.mode("overwrite").json(path)


def relevant_pairs(cases: DataFrame) -> DataFrame:
    return cases.select("query_id", F.inline("relevant"))


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(local_path, size_bytes, sha256, content) of every file below `path`. The hash is a
    projection over the scan; select what you need and the content is not carried on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.regexp_replace("path", "^file:(//)?", "").alias("local_path"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
        "content",
    )


@F.pandas_udf(T.StringType())
def _readable(content: pd.Series) -> pd.Series:
    return content.map(lambda data: bytes(data).decode("utf-8", errors="ignore"), na_action="ignore")


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """(local_path, html). Bytes that are not UTF-8 are dropped."""
    return stored_files(spark, path).select("local_path", _readable("content").alias("html"))

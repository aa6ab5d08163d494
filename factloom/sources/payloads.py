"""Nested JSON payloads to rows: columnar submissions and structured facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import scope
from factloom.model import FACTS_DOCUMENT, SUBMISSIONS, SUBMISSIONS_BLOCK

COLUMNS = tuple(SUBMISSIONS_BLOCK.fieldNames())


def columnar_to_rows(df: DataFrame, block: str, columns=COLUMNS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Transpose a struct of parallel arrays. Ragged arrays raise; `arrays_zip` alone would pad
    them with NULLs and misattribute every later field. Empty blocks give no rows."""
    arrays = [F.coalesce(F.col(f"{block}.{c}"), F.array().cast("array<string>")) for c in columns]
    sizes = F.array(*[F.size(a) for a in arrays])
    message = F.concat(F.lit("ragged columnar block: "), F.array_join(F.transform(sizes, lambda n: n.cast("string")), ","))
    zipped = F.arrays_zip(*[a.alias(c) for a, c in zip(arrays, columns)])
    checked = F.when(F.array_min(sizes) == F.array_max(sizes), zipped).otherwise(F.raise_error(message))
    exploded = df.select(*keep, F.posexplode(checked).alias("position", "row"))
    return exploded.select(*keep, "position", *[F.col("row").getField(c).alias(c) for c in columns])


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).json(path, multiLine=True)


def listing_rows(main: DataFrame, overflow: DataFrame | None, years=scope.FISCAL_YEARS) -> DataFrame:
    """All listed filings: the inline page (page 0) and the overflow files that touch the window.

    main: ticker, cik, filings; overflow: ticker, cik, name, filingFrom, filingTo, block. The
    window is a literal filter, so files outside it are never parsed."""
    from factloom.operators.filing_index import overlapping, period_window

    inline = columnar_to_rows(
        main.select("ticker", "cik", F.col("filings.recent").alias("block")), "block", keep=("ticker", "cik")
    ).withColumn("page", F.col("position").cast("bigint"))
    parts = inline
    if overflow is not None:
        low, high = period_window(years)
        more = columnar_to_rows(
            overlapping(overflow, "filingFrom", "filingTo", low, high), "block", keep=("ticker", "cik", "name")
        ).withColumn("page", F.col("position").cast("bigint") + F.lit(1 << 40)).drop("name")
        parts = inline.unionByName(more)
    return parts.select(
        "ticker", "cik", "page", "form", "items",
        F.col("accessionNumber").alias("accession_no"),
        F.to_date(F.nullif("reportDate", F.lit(""))).alias("report_date"),
        F.to_date("filingDate").alias("filing_date"),
        F.col("primaryDocument").alias("primary_document"),
    )


def parse_facts(payload: Column) -> Column:
    return F.from_json(payload, FACTS_DOCUMENT)


def facts_from_documents(docs: DataFrame, concepts, taxonomy: str = scope.TAXONOMY) -> DataFrame:
    """Flat facts from (ticker, cik, doc) where doc follows the facts document schema. Concepts
    are filtered between the two explodes, before observations are unfolded."""
    by_concept = docs.select(
        "ticker", "cik", F.explode(F.try_element_at("doc.facts", F.lit(taxonomy))).alias("concept", "entry")
    ).filter(F.col("concept").isin(*concepts))
    by_unit = by_concept.select("ticker", "cik", "concept", F.explode("entry.units").alias("unit", "observations"))
    return by_unit.select("ticker", "cik", "concept", "unit", F.inline("observations")).select(
        "ticker", "cik", "concept", "unit",
        F.col("val").alias("value"),
        F.to_date(F.nullif("start", F.lit(""))).alias("period_start"),
        F.to_date("end").alias("period_end"),
        F.col("accn").alias("accession_no"),
        F.coalesce("form", F.lit("")).alias("form"),
        F.to_date("filed").alias("filed_date"),
        F.lit(False).alias("restated"),
    )


def held_facts(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Only facts whose source filing is in the corpus can be cited."""
    return facts.join(filings.select("accession_no"), "accession_no", "left_semi")


def tracked_concepts(ticker: str) -> tuple[str, ...]:
    return (*scope.CORE_CONCEPTS, scope.REVENUE_CONCEPT_BY_TICKER[ticker])


def tracked_filter(ticker: Column, concept: Column) -> Column:
    """Core concepts for everyone; a revenue concept only for the filers that use it."""
    from factloom.functions.filings import mapped

    return concept.isin(*scope.CORE_CONCEPTS) | (concept == mapped(scope.REVENUE_CONCEPT_BY_TICKER, F.upper(ticker)))

"""Declared schemas. Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, BIG, NUM = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
DAY, FLAG, STRS, INTS = T.DateType(), T.BooleanType(), T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FILING = struct(
    ticker=STR, cik=INT, form=STR, accession_no=STR, report_date=DAY, filing_date=DAY, fiscal_year=INT,
    primary_document=STR, items=STRS, is_amendment=FLAG, fy_ambiguous=FLAG,
)
MANIFEST = T.StructType(
    FILING.fields + struct(local_path=STR, sha256=STR, size_bytes=BIG, downloaded=FLAG).fields
)
CHUNK = struct(
    chunk_id=STR, accession_no=STR, ticker=STR, cik=INT, form_type=STR, fiscal_year=INT, fiscal_period=DAY,
    filing_date=DAY, item_section=STR, start_line=INT, end_line=INT, text=STR,
)
FACT = struct(
    ticker=STR, cik=INT, concept=STR, unit=STR, value=NUM, period_start=DAY, period_end=DAY,
    accession_no=STR, form=STR, filed_date=DAY, restated=FLAG,
)
QUESTION = struct(
    question_id=STR, question=STR, question_type=STR, tickers=STRS, concept=STR, fiscal_years=INTS,
    expected_value=NUM, expected_text=STR, unit=STR, rel_tolerance=NUM, abs_tolerance=NUM,
    source_accessions=STRS,
)
RETRIEVAL_CASE = struct(
    case_id=STR, query=STR, relevant=T.ArrayType(STRS), tickers=STRS, fiscal_years=INTS
)
# Nested facts document: taxonomy -> concept -> unit -> observations.
OBSERVATION = struct(start=STR, end=STR, val=NUM, accn=STR, form=STR, filed=STR)
FACTS_DOCUMENT = struct(
    cik=BIG,
    entityName=STR,
    facts=T.MapType(STR, T.MapType(STR, struct(units=T.MapType(STR, T.ArrayType(OBSERVATION))))),
)
# Columnar submissions payload: parallel arrays plus a list of overflow files.
SUBMISSIONS_BLOCK = struct(
    accessionNumber=STRS, filingDate=STRS, reportDate=STRS, form=STRS, items=STRS, primaryDocument=STRS
)
OVERFLOW_FILE = struct(name=STR, filingFrom=STR, filingTo=STR)
SUBMISSIONS = struct(
    cik=STR, name=STR, filings=struct(recent=SUBMISSIONS_BLOCK, files=T.ArrayType(OVERFLOW_FILE))
)

"""Expressions over filing metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import scope


def fiscal_year(period_end: Column) -> Column:
    return F.year(period_end)


def fiscal_year_ambiguous(period_end: Column) -> Column:
    return (F.month(period_end) == 1) & (F.dayofmonth(period_end) <= scope.FY_AMBIGUITY_DAYS)


def base_form(form: Column) -> Column:
    return F.regexp_replace(form, "/A$", "")


def is_amendment(form: Column) -> Column:
    return form.endswith("/A")


def archive_url(cik: Column, accession_no: Column, document: Column) -> Column:
    return F.format_string(scope.ARCHIVE_URL, cik.cast("string"), F.replace(accession_no, F.lit("-"), F.lit("")), document)


def local_path(root: str, ticker: Column, accession_no: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), ticker, accession_no, document)


def citation(accession_no: Column, section: Column, chunk_id: Column) -> Column:
    return F.concat_ws("#", accession_no, section, chunk_id)


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def mapped(pairs: dict, key: Column) -> Column:
    """Lookup in a small fixed table; NULL when absent."""
    return F.try_element_at(literal_map(pairs), key)


def concept_of(ticker: Column, label: Column) -> Column:
    """Tracked concept names pass through; plain labels are mapped, revenue per filer."""
    exact = sorted({*scope.CORE_CONCEPTS, *scope.REVENUE_CONCEPT_BY_TICKER.values()})
    plain = F.replace(F.lower(F.btrim(label)), F.lit("'"), F.lit(""))
    return (
        F.when(label.isin(*exact), label)
        .when(
            plain.isin(*scope.REVENUE_LABELS),
            mapped(scope.REVENUE_CONCEPT_BY_TICKER, F.upper(ticker)),
        )
        .otherwise(mapped(scope.LABEL_TO_CONCEPT, plain))
    )


def claim_year(period: Column, fallback: Column, years=scope.FISCAL_YEARS) -> Column:
    """First in-scope four-digit year named in the period text, else the filing's own year."""
    found = F.regexp_extract_all(F.coalesce(period, F.lit("")), F.lit(r"(?<!\d)20\d{2}(?!\d)"), F.lit(0))
    named = F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.isin(*years))
    return F.coalesce(F.get(named, 0), fallback)

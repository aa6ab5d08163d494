"""From stored pages and facts documents to gated chunks and resolved facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions.markup import html_to_text
from factloom.functions.text import leaked_prefixes
from factloom.model import CHUNK, FACT, FILING, QUESTION
from factloom.operators import chunks as ck
from factloom.operators import facts as fa
from factloom.operators import filing_index as ix
from factloom.operators import sections as sc
from factloom.operators.embedding import Encoder, embed_pending
from factloom.operators.gates import enforce, union_all, unique_key, violations
from factloom.sources.payloads import facts_from_documents, held_facts, tracked_filter
from factloom.sources.tables import append_new, create_table, reload

STUBS = [f"{t}/{s}" for t, names in scope.STUB_ALLOWLIST.items() for s in names]


def extracted(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Manifest rows with the text of their page. The join moves pages as stored; parsing comes
    after it and only for filings of the corpus."""
    held = manifest.filter("downloaded")
    joined = held.join(pages, "local_path").select(
        "accession_no", "ticker", "cik", F.col("form").alias("form_type"), "fiscal_year",
        F.col("report_date").alias("fiscal_period"), "filing_date", F.length("html").alias("html_chars"),
        html_to_text(F.col("html")).alias("text"),
    )
    return joined


def text_gates(texts: DataFrame) -> DataFrame:
    """Metadata that leaked into the text, and texts too short for their page."""
    found = texts.withColumn("leaked", leaked_prefixes(F.col("text"))).filter(F.size("leaked") > 0)
    ratio = F.length("text") / F.greatest("html_chars", F.lit(1))
    thin = texts.withColumn("ratio", ratio).filter(F.col("ratio") < scope.MIN_TEXT_RATIO)
    return union_all(
        [
            violations(found, "leaked metadata", F.col("accession_no"), F.array_join("leaked", ",")),
            violations(thin, "implausibly short text", F.col("accession_no"), F.format_string("%.4f", "ratio")),
        ]
    )


def section_gates(texts: DataFrame) -> DataFrame:
    """Overlapping sections, and required ones that are missing or mere stubs."""
    lined = texts.withColumn("lines", F.split("text", "\n"))
    found = lined.select(
        "accession_no", "ticker", F.col("form_type").alias("form"), sc.sections_in(F.col("lines"), F.col("form_type")).alias("sections")
    )
    flat = found.select("accession_no", F.inline("sections"))
    stub = F.array(*[F.lit(s) for s in STUBS])
    allowed = F.transform(
        F.filter(stub, lambda s: F.startswith(s, F.concat("ticker", F.lit("/")))), lambda s: F.substring_index(s, "/", -1)
    )
    thin = sc.thin_sections(found, flat, ["accession_no"], allowed)
    return sc.order_gate(flat, ["accession_no"]).unionByName(
        violations(thin, "thin section", F.concat_ws("/", "accession_no", "name"), F.col("n_lines"))
    )


def build_chunks(manifest: DataFrame, pages: DataFrame, gates: tuple[str, ...] = ("text", "chunks")) -> DataFrame:
    """Gated chunks of every downloaded filing. Gates: text, sections, chunks."""
    texts = extracted(manifest, pages)
    chunks = ck.chunk_filings(texts)
    if "text" in gates:
        enforce(text_gates(texts))
    if "sections" in gates:
        enforce(section_gates(texts))
    if "chunks" in gates:
        lines = texts.select("accession_no", F.split("text", "\n").alias("lines"))
        enforce(ck.validity_gate(chunks, lines, "accession_no"))
    return chunks


def build_facts(documents: DataFrame, manifest: DataFrame, allowed=scope.RESTATEMENT_ALLOWLIST, coverage: bool = False) -> DataFrame:
    """Resolved facts of the corpus from (ticker, cik, doc) facts documents."""
    held = manifest.filter("downloaded")
    concepts = sorted({*scope.CORE_CONCEPTS, *scope.REVENUE_CONCEPT_BY_TICKER.values()})
    raw = held_facts(
        facts_from_documents(documents, concepts).filter(tracked_filter(F.col("ticker"), F.col("concept"))), held
    )
    enforce(fa.traceable_gate(raw, held))
    enforce(fa.conflict_gate(raw, allowed))
    if coverage:
        enforce(fa.coverage_gate(held.select("ticker").distinct(), raw))
    return fa.resolve_restatements(raw)


def corpus_gates(manifest: DataFrame, entities: DataFrame, disk: DataFrame, years=scope.FISCAL_YEARS) -> DataFrame:
    """Scope, completeness and integrity of the manifest in one table of violations."""
    return union_all(
        [
            ix.fiscal_period_gate(manifest, years),
            ix.completeness_gate(entities, manifest, years),
            ix.integrity_gate(manifest, disk),
            unique_key(manifest, ["accession_no"]),
        ]
    )


def create_tables(spark: SparkSession) -> None:
    from pyspark.sql import types as T

    create_table(spark, "filings", FILING)
    create_table(spark, "chunks", CHUNK)
    create_table(spark, "facts", FACT)
    create_table(spark, "questions", QUESTION)
    create_table(spark, "vectors", T.StructType().add("chunk_id", T.StringType()).add("embedding", T.ArrayType(T.DoubleType())))


def load(spark: SparkSession, **tables: DataFrame) -> None:
    """Idempotent load of any of filings, chunks, facts, questions."""
    for name, rows in tables.items():
        append_new(spark, name, rows)


def rebuild_index(spark: SparkSession, chunks: DataFrame, encoder: Encoder) -> None:
    """Replace chunks and vectors after a change of chunking parameters."""
    reload(spark, "chunks", chunks)
    stored = spark.table("chunks").select(F.col("chunk_id"), "text")
    none = stored.limit(0).select("chunk_id", F.lit(None).cast("array<double>").alias("embedding"))
    reload(spark, "vectors", embed_pending(stored, none, encoder, "chunk_id"))

"""Size-bounded chunks that never split a line and never cross a section.

Packing is a fold over line lengths. Only the lengths, the table-row flags and the section spans
go to the Arrow function; the text stays in the JVM, where chunk texts are sliced from the lines.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import scope
from factloom.functions.numeric import estimated_tokens
from factloom.functions.text import is_table_row, strip
from factloom.operators.gates import union_all, violations
from factloom.operators.scan import Scan, block_scan, line_block
from factloom.operators.sections import sections_in, tile_spans
from factloom.session import cut_lineage

_RANGE = T.StructType().add("name", T.StringType()).add("start_line", T.IntegerType()).add("end_line", T.IntegerType())


def packed_ranges(lengths: Sequence[int], tabular: Sequence[bool], start: int, end: int) -> list[tuple[int, int]]:
    """Greedy line ranges of one span. Two table rows in sequence may run on to the larger limit.

    Most documents have a few lines, where plain numbers are faster than arrays."""
    if end <= start:
        return []
    cuts, held, before = [start], lengths[start] + 1, tabular[start]
    for line in range(start + 1, end):
        cost, now = lengths[line] + 1, tabular[line]
        held += cost
        if held > (scope.MAX_CHARS if now and before else scope.TARGET_CHARS):
            cuts.append(line)
            held = cost
        before = now
    return list(zip(cuts, [*cuts[1:], end]))


@F.arrow_udf(T.ArrayType(_RANGE))
def pack(lengths: pa.Array, tabular: pa.Array, spans: pa.Array) -> pa.Array:
    names, starts, ends, offsets = [], [], [], [0]
    for at in range(len(lengths)):
        size, rows = lengths[at].as_py(), tabular[at].as_py()
        for tile in spans[at].as_py() if size is not None else ():  # a document without text has no lines
            for first, last in packed_ranges(size, rows, tile["start_line"], tile["end_line"]):
                names.append(tile["name"])
                starts.append(first)
                ends.append(last)
        offsets.append(len(names))
    ranges = pa.StructArray.from_arrays(
        [pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["name", "start_line", "end_line"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ranges)


def chunk_rows(documents: DataFrame, keys: list[str], lines: str = "lines", spans: str = "spans") -> DataFrame:
    """One row per chunk: keys, chunk_index, item_section, start_line, end_line, text.

    Map-only: a document's chunks come from its own row. Blank chunks are dropped before
    numbering, so indexes stay dense."""
    ranges = pack(
        F.transform(lines, lambda x: F.length(x)), F.transform(lines, is_table_row), F.col(spans)
    )
    texts = F.transform(
        F.col("ranges"),
        lambda r: F.struct(
            r["name"].alias("item_section"), r["start_line"].alias("start_line"), r["end_line"].alias("end_line"),
            strip(
                F.array_join(F.slice(F.col(lines), r["start_line"] + 1, r["end_line"] - r["start_line"]), "\n")
            ).alias("text"),
        ),
    )
    return (
        documents.withColumn("ranges", ranges)
        .select(*keys, F.posexplode(F.filter(texts, lambda c: c["text"] != "")).alias("chunk_index", "c"))
        .select(*keys, "chunk_index", "c.*")
    )


def whole_span(lines: Column) -> Column:
    return F.array(
        F.struct(
            F.lit(scope.UNSECTIONED).alias("name"), F.lit(0).alias("start_line"), F.size(lines).alias("end_line")
        )
    )


def chunk_filings(filings: DataFrame) -> DataFrame:
    """Chunks of extracted filings (accession_no, form, text and metadata): sections are found,
    tiled and packed row by row, with no shuffle at all."""
    meta = ["accession_no", "ticker", "cik", "form_type", "fiscal_year", "fiscal_period", "filing_date"]
    lined = filings.withColumn("lines", F.split("text", "\n"))
    spans = tile_spans(sections_in(F.col("lines"), F.col("form_type")), F.size("lines"))
    # Exploding the one-element array keeps the nested expression out of the Arrow call's
    # arguments, where Spark would not be able to plan it.
    prepared = lined.select("*", F.explode(F.array(spans)).alias("spans"))
    rows = chunk_rows(prepared, meta)
    return rows.select(
        chunk_id(F.col("accession_no"), F.col("chunk_index")).alias("chunk_id"),
        *meta, "item_section", "start_line", "end_line", "text",
    )


def chunk_id(accession_no: Column, index: Column) -> Column:
    """`<accession>:<index>`, at least four digits; longer indexes are kept whole."""
    number = index.cast("string")
    return F.concat(
        accession_no.cast("string"), F.lit(":"),
        F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number),
    )


def with_size(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("n_chars", F.length("text")).withColumn(
        "estimated_tokens", estimated_tokens(F.length("text"))
    )


def validity_gate(chunks: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Overlap, oversize, lost table rows, duplicate ids. `lines` is (key, lines array)."""
    # Everything but the table-row check needs only ids, line numbers and sizes.
    slim = cut_lineage(chunks.select("chunk_id", key, "start_line", "end_line", F.length("text").alias("n_chars")))
    late = block_scan(
        slim, [key], ["start_line", "chunk_id"], line_block("start_line"), reached=Scan("max_before", F.col("end_line"))
    ).filter("start_line < reached")
    oversize = slim.filter((F.col("end_line") - F.col("start_line") > 1) & (F.col("n_chars") > scope.MAX_CHARS))
    # Table rows of each chunk's own line range, cut from the document row before any shuffle.
    rows = lines.select(
        key, F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: is_table_row(x["line"])).alias("rows")
    ).filter(F.size("rows") > 0)
    lost = (
        chunks.join(rows, key)
        .filter(
            F.exists(
                "rows",
                lambda x: (x["line_no"] >= F.col("start_line")) & (x["line_no"] < F.col("end_line"))
                & ~F.contains(F.col("text"), strip(x["line"])),
            )
        )
    )
    copies = slim.groupBy("chunk_id").count().filter("count > 1")
    ident = F.col("chunk_id")
    return union_all(
        [
            violations(late, "overlaps previous chunk", ident, F.col("start_line")),
            violations(oversize, "oversize", ident, F.col("n_chars")),
            violations(lost, "table row lost", ident, F.lit("")),
            violations(copies, "duplicate chunk id", ident, F.col("count")),
        ]
    )

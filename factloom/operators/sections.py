"""Item-anchored sections of a filing.

Two forms of the same operator: on a row that holds the whole document as an array of lines
(no shuffle, the text never moves), and on a table with one row per line for documents whose
lines arrive as rows. Both look at heading lines only; body lines never enter a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions.filings import mapped
from factloom.functions.text import strip
from factloom.operators.gates import violations
from factloom.operators.scan import Scan, block_scan, line_block, per_key_top
from factloom.session import cut_lineage


def _part(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, scope.PART_PATTERN, 1))


def _item(text: Column) -> Column:
    """Item code of a titled heading, '' for anything else (bare contents entries included)."""
    title = F.btrim(F.regexp_extract(text, scope.ITEM_PATTERN, 2), F.lit(" .|"))
    code = F.upper(F.regexp_extract(text, scope.ITEM_PATTERN, 1))
    return F.when(F.length(title) >= scope.MIN_TITLE_CHARS, code).otherwise(F.lit(""))


def _eligible(text: Column) -> Column:
    return F.length(text).between(1, scope.MAX_HEADING_CHARS)


def section_name(form: Column, part: Column, item: Column) -> Column:
    quarterly = F.upper(form).startswith("10-Q")
    return F.when(
        quarterly, mapped(scope.QUARTERLY_SECTIONS, F.concat_ws("/", part, item))
    ).otherwise(mapped(scope.ANNUAL_SECTIONS, item))


# --- one row per document ---------------------------------------------------------------------

_HEADING = "array<struct<line:int,part:string,item:string,heading:string>>"


def headings_in(lines: Column) -> Column:
    """ARRAY<STRUCT<line, part, item, heading>> of a document's titled Item headings."""
    numbered = F.transform(lines, lambda text, i: F.struct(i.alias("line"), strip(text).alias("text")))
    marks = F.transform(
        F.filter(numbered, lambda x: _eligible(x["text"])),
        lambda x: F.struct(
            x["line"].alias("line"), x["text"].alias("text"),
            _part(x["text"]).alias("part"), _item(x["text"]).alias("item"),
        ),
    )
    few = F.filter(marks, lambda x: (x["part"] != "") | (x["item"] != ""))
    folded = F.reduce(
        few,
        F.struct(F.lit("").alias("part"), F.array().cast(_HEADING).alias("out")),
        lambda acc, x: F.when(
            x["part"] != "", F.struct(x["part"].alias("part"), acc["out"].alias("out"))
        ).otherwise(
            F.struct(
                acc["part"].alias("part"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            x["line"].alias("line"), acc["part"].alias("part"),
                            x["item"].alias("item"), x["text"].alias("heading"),
                        )
                    ),
                ).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
    return folded


def sections_in(lines: Column, form: Column) -> Column:
    """ARRAY<STRUCT<name, start_line, end_line, heading, item>>, ordered by start line.

    A section runs to the next heading with another item; per name the longest run is kept."""

    def of(heads: Column) -> Column:
        candidates = F.filter(
            F.transform(
                heads,
                lambda h: F.struct(
                    section_name(form, h["part"], h["item"]).alias("name"),
                    h["line"].alias("start_line"),
                    F.coalesce(
                        F.array_min(
                            F.transform(
                                F.filter(heads, lambda g: (g["line"] > h["line"]) & (g["item"] != h["item"])),
                                lambda g: g["line"],
                            )
                        ),
                        F.size(lines),
                    ).alias("end_line"),
                    h["heading"].alias("heading"),
                    h["item"].alias("item"),
                ),
            ),
            lambda c: c["name"].isNotNull(),
        )
        longest = F.filter(
            candidates,
            lambda c: ~F.exists(
                candidates,
                lambda d: (d["name"] == c["name"])
                & (
                    (d["end_line"] - d["start_line"] > c["end_line"] - c["start_line"])
                    | (
                        (d["end_line"] - d["start_line"] == c["end_line"] - c["start_line"])
                        & (d["start_line"] < c["start_line"])
                    )
                ),
            ),
        )
        return longest

    # The one-element transform binds the headings once, so they are not recomputed per use.
    return F.get(F.transform(F.array(headings_in(lines)), of), 0)


# --- one row per line --------------------------------------------------------------------------

def heading_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Heading table (keys, line_no, part, item, heading) from a table of (keys, line_no, text).

    The current part is carried forward across blocks of lines, so one huge document spreads
    over many tasks."""
    text = strip(F.col("text"))
    marks = (
        lines.select(*keys, "line_no", text.alias("heading"))
        .filter(_eligible(F.col("heading")))
        .withColumn("part_mark", F.nullif(_part(F.col("heading")), F.lit("")))
        .withColumn("item", F.when(F.col("part_mark").isNull(), _item(F.col("heading"))).otherwise(F.lit("")))
        .filter("part_mark is not null or item <> ''")
    )
    carried = block_scan(
        marks, keys, ["line_no"], line_block("line_no"), part=Scan("last", F.col("part_mark"))
    )
    return carried.filter("item <> ''").select(
        *keys, "line_no", F.coalesce("part", F.lit("")).alias("part"), "item", "heading"
    )


def section_rows(headings: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Sections from heading rows; `documents` gives (keys, form, n_lines).

    Runs of equal items are islands: the end of a section is the first line of the next island.
    Headings are a few rows per document and every scan reads its input twice, so their lineage is
    cut once here instead of reading the lines again for each scan."""
    headings = cut_lineage(headings)
    with_previous = block_scan(
        headings, keys, ["line_no"], line_block("line_no"), previous=Scan("last_before", F.col("item"))
    )
    island_start = F.when(~F.col("item").eqNullSafe(F.col("previous")), F.col("line_no"))
    with_next = block_scan(
        with_previous.withColumn("island", island_start), keys, ["line_no"], line_block("line_no"),
        next_island=Scan("next_after", F.col("island")),
    )
    spans = (
        with_next.join(documents, keys)
        .withColumn("name", section_name(F.col("form"), F.col("part"), F.col("item")))
        .filter("name is not null")
        .withColumn("end_line", F.coalesce("next_island", "n_lines"))
    )
    best = per_key_top(
        spans, [*keys, "name"], [F.desc(F.col("end_line") - F.col("line_no")), F.asc("line_no")], 1
    )
    return best.select(
        *keys, "name", F.col("line_no").alias("start_line"), "end_line", "heading", "item"
    )


def tile_rows(sections: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Cover [0, n_lines) of every document: its sections plus UNSECTIONED gaps.

    At most one row per section name and document takes part, so grouping per document is small."""
    packed = sections.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name"))).alias("s")
    )
    tiled = documents.join(packed, keys, "left").withColumn(
        "span", F.explode(tile_spans(F.col("s"), F.col("n_lines")))
    )
    return tiled.select(*keys, "span.name", "span.start_line", "span.end_line")


def tile_spans(sections: Column, n_lines: Column) -> Column:
    """ARRAY<STRUCT<name, start_line, end_line>> tiling of one document (input sorted by start)."""
    shape = "array<struct<name:string,start_line:int,end_line:int>>"

    def span(name: Column, start: Column, end: Column) -> Column:
        return F.array(
            F.struct(name.alias("name"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))
        )

    gap_name, none = F.lit(scope.UNSECTIONED), F.array().cast(shape)

    def gap(start: Column, end: Column) -> Column:
        return F.when(start < end, span(gap_name, start, end)).otherwise(none)

    plain = F.transform(
        sections,
        lambda s: F.struct(
            s["name"].alias("name"), s["start_line"].cast("int").alias("start_line"),
            s["end_line"].cast("int").alias("end_line"),
        ),
    )
    return F.reduce(
        F.coalesce(plain, none),
        F.struct(F.lit(0).alias("cursor"), none.alias("out")),
        lambda acc, s: F.struct(
            s["end_line"].cast("int").alias("cursor"),
            F.concat(
                acc["out"], gap(acc["cursor"], s["start_line"]), span(s["name"], s["start_line"], s["end_line"])
            ).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], gap(acc["cursor"], n_lines)),
    )


# --- gates --------------------------------------------------------------------------------------

def overlaps(spans: DataFrame, keys: list[str], start: str, end: str, block: Column, tie: str) -> DataFrame:
    """Spans that start before an earlier span of the same key has ended."""
    scanned = block_scan(spans, keys, [start, tie], block, reached=Scan("max_before", F.col(end)))
    return scanned.filter(F.col(start) < F.col("reached"))


def order_gate(sections: DataFrame, keys: list[str]) -> DataFrame:
    bad = overlaps(sections, keys, "start_line", "end_line", line_block("start_line"), "name")
    return violations(
        bad, "overlapping sections", F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col("name")),
        F.format_string("starts %d before %d", "start_line", "reached"),
    )


def required_sections(form: Column) -> Column:
    annual = F.array(*[F.lit(s) for s in scope.REQUIRED_ANNUAL])
    quarterly = F.array(*[F.lit(s) for s in scope.REQUIRED_QUARTERLY])
    return F.when(F.upper(form).startswith("10-Q"), quarterly).otherwise(annual)


def thin_sections(
    documents: DataFrame, sections: DataFrame, keys: list[str], allowed: Column, min_lines: int = scope.MIN_SECTION_LINES
) -> DataFrame:
    """Required sections that are missing (n_lines -1) or shorter than `min_lines`."""
    wanted = documents.select(
        *keys, F.explode(F.array_except(required_sections(F.col("form")), allowed)).alias("name")
    )
    found = sections.select(*keys, "name", (F.col("end_line") - F.col("start_line")).alias("n_lines"))
    return (
        wanted.join(found, [*keys, "name"], "left")
        .withColumn("n_lines", F.coalesce("n_lines", F.lit(-1)))
        .filter(F.col("n_lines") < min_lines)
    )

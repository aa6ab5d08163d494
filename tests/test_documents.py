"""Scans, sections, tiling and chunks on literal documents."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import scope
from factloom.functions import markup
from factloom.operators import chunks as ck
from factloom.operators import sections as sc
from factloom.operators.gates import GateError, enforce
from factloom.operators.scan import Scan, block_scan, line_block, per_key_top


def test_block_scan_equals_plain_window(spark):
    """A hot key over many blocks gives what one window over the key gives."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None]), i, rng.choice([None, 1, 2, 3])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = block_scan(
        df, ["k"], ["i"], line_block("i", 16), pos=Scan("position"), tot=Scan("total", F.col("v")), last=Scan("last", F.col("v")),
        before=Scan("last_before", F.col("v")), top=Scan("max_before", F.col("v")), nxt=Scan("next_after", F.col("v")),
    )
    w = Window.partitionBy("k").orderBy("i")
    up, earlier, later = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "k", "i", "v", F.row_number().over(w).cast("bigint").alias("pos"), F.sum("v").over(up).alias("tot"), F.last("v", True).over(up).alias("last"),
        F.last("v", True).over(earlier).alias("before"), F.max("v").over(earlier).alias("top"), F.first("v", True).over(later).alias("nxt"),
    )
    key = lambda r: (r.k or "", r.i)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_top_per_key_prunes_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = per_key_top(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Partial") > plan.index("Exchange")


CONTENTS = ["Part I", "Item 1.", "Item 1A.", "Item 7.", "Item 7A.", "Item 8."]
BODY = [
    "Item 1. Business", *["We design platforms."] * 20,
    "Item 1A. Risk Factors", *["We face risks."] * 40,
    "Item 1B. Unresolved Staff Comments", "None.",
    "Item 7—Management's Discussion and Analysis " + "of operations " * 9, *["Revenue increased."] * 30,
    "Item 7A. Quantitative Disclosures about Market Risk", *["Rates move."] * 15,
    "Item 8. Financial Statements", *["Revenue | $130 | $60"] * 25,
]
QUARTER = [
    "Part I. Financial Information", "Item 1. Financial Statements", *["Revenue | $44"] * 30, "Item 2. Management's Discussion",
    *["Up."] * 20, "Part II. Other Information", "Item 1. Legal Proceedings", "See Note 12.", "Item 1A. Risk Factors", *["Risks."] * 15,
]


def in_row(spark, lines, form="10-K"):
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    return df.select(sc.sections_in(F.col("lines"), F.lit(form)).alias("s")).first().s


def by_rows(spark, lines, form="10-K"):
    table = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "d string, line_no int, text string")
    docs = spark.createDataFrame([("d", len(lines), form)], "d string, n_lines int, form string")
    return sc.section_rows(sc.heading_rows(table, ["d"]), docs, ["d"]).orderBy("start_line").collect()


@pytest.mark.parametrize(
    ("lines", "form"),
    [(CONTENTS + BODY, "10-K"), (CONTENTS + BODY[:2] + BODY, "10-K"), (QUARTER, "10-Q"), (["no heading"] * 3, "10-K"),
     (["Item 7. Discussion"] + ["x"] * 3 + ["Item 7. Discussion continued"] + ["x"] * 3 + ["Item 8. Statements"], "10-K"),
     (["PART IV", "item 1a: risk factors", "x" * 401 + " Item 8. Statements", "Item 8) Statements here"], "10-K")],
)
def test_both_section_forms_agree(spark, lines, form):
    a, b = in_row(spark, lines, form), by_rows(spark, lines, form)
    fields = ("name", "start_line", "end_line", "heading", "item")
    assert [tuple(x[f] for f in fields) for x in a] == [tuple(x[f] for f in fields) for x in b]


def test_sections_of_an_annual_report(spark):
    found = {s.name: s for s in in_row(spark, CONTENTS + BODY)}
    risk = found["RISK_FACTORS"]
    assert risk.heading == "Item 1A. Risk Factors" and risk.start_line > 5 and risk.end_line - risk.start_line == 41
    assert found["MDA"].item == "7" and found["MARKET_RISK"].item == "7A" and set(found) == set(scope.SECTION_ORDER)


def test_quarterly_items_need_their_part(spark):
    found = {s.name: s for s in in_row(spark, QUARTER, "10-Q")}
    assert found["FINANCIAL_STATEMENTS"].heading == "Item 1. Financial Statements" and found["RISK_FACTORS"].item == "1A" and "MDA" in found


def tables(spark, lines, form="10-K"):
    docs = spark.createDataFrame([("d", form)], "d string, form string")
    found = spark.createDataFrame([(lines,)], "lines array<string>").select(
        F.lit("d").alias("d"), F.inline(sc.sections_in(F.col("lines"), F.lit(form)))
    )
    return docs, found


def test_substance(spark):
    none = F.array().cast("array<string>")
    docs, found = tables(spark, CONTENTS + BODY)
    assert sc.thin_sections(docs, found, ["d"], none).isEmpty()
    stub = ["Item 1A. Risk Factors", *["r"] * 30, "Item 7. Management's Discussion", "Refer to pages 133-142.", "Item 8. Statements here", *["s"] * 20]
    docs, found = tables(spark, stub)
    thin = {r.name: r.n_lines for r in sc.thin_sections(docs, found, ["d"], none).collect()}
    assert thin == {"MDA": 2, "MARKET_RISK": -1}
    allowed = F.array(F.lit("MDA"), F.lit("MARKET_RISK"))
    assert sc.thin_sections(docs, found, ["d"], allowed).isEmpty()


def test_order_gate(spark):
    bad = spark.createDataFrame([("d", "MDA", 10, 90), ("d", "MARKET_RISK", 50, 99)], "d string, name string, start_line int, end_line int")
    with pytest.raises(GateError, match="MARKET_RISK"):
        enforce(sc.order_gate(bad, ["d"]))
    enforce(sc.order_gate(bad.filter("name = 'MDA'"), ["d"]))


SECTIONS = "array<struct<name:string,start_line:int,end_line:int,heading:string,item:string>>"


def tiling(spark, sections, n):
    df = spark.createDataFrame([([(a, b, c, "", "") for a, b, c in sections],)], f"s {SECTIONS}")
    return [tuple(x) for x in df.select(sc.tile_spans(F.col("s"), F.lit(n)).alias("t")).first().t]


def test_tiling(spark):
    tiles = tiling(spark, [("RISK_FACTORS", 2, 6), ("MDA", 6, 10)], 14)
    assert tiles == [("UNSECTIONED", 0, 2), ("RISK_FACTORS", 2, 6), ("MDA", 6, 10), ("UNSECTIONED", 10, 14)]
    assert tiling(spark, [], 3) == [("UNSECTIONED", 0, 3)]


def filing(spark, lines, form="10-K"):
    meta = ("acc-1", "NVDA", 1045810, form, 2025, "\n".join(lines))
    df = spark.createDataFrame([meta], "accession_no string, ticker string, cik int, form_type string, fiscal_year int, text string")
    return df.withColumn("fiscal_period", F.lit("2025-01-26").cast("date")).withColumn("filing_date", F.lit("2025-02-26").cast("date"))


def chunks_of(spark, lines):
    return ck.chunk_filings(filing(spark, lines)).orderBy("start_line").collect()


def test_rows_are_never_split(spark):
    rows = [f"Line item {i} | {i * 1000:,} | {i * 2000:,}" for i in range(400)]
    got = chunks_of(spark, rows)
    assert len(got) > 1 and "\n".join(c.text for c in got) == "\n".join(rows)
    assert any(len(c.text) > scope.TARGET_CHARS for c in got) and all(len(c.text) <= scope.MAX_CHARS for c in got)


def test_oversize_line_stays_whole(spark):
    monster = "Item | " + " | ".join(str(n) for n in range(2000))
    got = chunks_of(spark, [monster])
    assert [c.text for c in got] == [monster]


def test_blank_documents_have_no_chunks(spark):
    assert chunks_of(spark, ["", "   ", ""]) == []


def test_chunks_keep_to_their_section(spark):
    lines = CONTENTS + BODY
    got = chunks_of(spark, lines)
    assert [c.chunk_id for c in got] == [f"acc-1:{i:04d}" for i in range(len(got))]
    assert {c.item_section for c in got} == {*scope.SECTION_ORDER, scope.UNSECTIONED}
    risk = [c for c in got if c.item_section == "RISK_FACTORS"]
    assert risk[0].start_line == lines.index("Item 1A. Risk Factors")
    covered = [i for c in got for i in range(c.start_line, c.end_line)]
    assert covered == list(range(len(lines)))


def test_chunk_gate(spark):
    lines = ["a | b"] * 10
    chunks = ck.chunk_filings(filing(spark, lines))
    held = spark.createDataFrame([("acc-1", lines)], "accession_no string, lines array<string>")
    enforce(ck.validity_gate(chunks, held, "accession_no"))
    rules = {r.rule for r in ck.validity_gate(chunks.unionByName(chunks), held, "accession_no").collect()}
    assert rules == {"overlaps previous chunk", "duplicate chunk id"}
    lost = chunks.withColumn("text", F.lit("gone"))
    assert {r.rule for r in ck.validity_gate(lost, held, "accession_no").collect()} == {"table row lost"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1500), st.booleans()), min_size=1, max_size=60))
def test_packing_properties(lines):
    """Ranges cover the span in order; a range grows until the next line would not fit."""
    import numpy as np

    lengths, tabular = np.array([n for n, _ in lines]), np.array([t for _, t in lines])
    ranges = ck.packed_ranges(lengths, tabular, 0, len(lines))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(lines)))
    for (a, b), following in zip(ranges, [*ranges[1:], None]):
        cost = lambda hi: int((lengths[a:hi] + 1).sum())
        limit = lambda i: scope.MAX_CHARS if i > a and tabular[i] and tabular[i - 1] else scope.TARGET_CHARS
        assert all(cost(i + 1) <= limit(i) for i in range(a + 1, b))
        if following:
            assert cost(b + 1) > limit(b)


def test_a_batch_of_pages_becomes_texts_a_few_at_a_time():
    pages = [f"<p>page {i}</p>" if i % 7 else None for i in range(300)]
    got = list(markup.read_pages(iter([pa.array(pages, pa.string()), pa.array([], pa.string())])))
    assert max(map(len, got)) <= markup.PAGES_AT_ONCE < 300
    assert [t for part in got for t in part.to_pylist()] == [markup.visible_text(p) for p in pages]

"""Document queries: markup, lines, sections, chunks, tokens.

Pages and documents are used as they are. Sectioned documents are the event streams of users,
each event rendered as one line of a filing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions import chunk_udtf
from factloom.functions import text as tx
from factloom.functions.markup import html_to_text
from factloom.functions.numeric import estimated_tokens
from factloom.operators import chunk_pointers as cp
from factloom.operators import chunks as ck
from factloom.operators import sections as sc
from factloom.operators.gates import violations
from factloom.operators.lexical import ANALYSERS
from factloom.operators.scan import Scan, block_scan, line_block, time_block
from factloom.plans.catalog import query, table, texts
from factloom.plans.index_queries import WS_SQL

NL = "chr(10)"


def strip_sql(value: str) -> str:
    return f"regexp_replace({value}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


TIDY_SQL = (
    "list_reduce(list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c <> ''), "
    "lambda a, c: a || CASE WHEN string_split(a, ' | ')[-1] IN ('$', '(', '$(') THEN '' ELSE ' | ' END || c)"
)


def normalise_sql(value: str) -> str:
    lines = f"list_transform(string_split({value}, {NL}), lambda x: trim(regexp_replace(x, '{WS_SQL}+', ' ', 'g')))"
    return (
        f"array_to_string(list_transform(list_filter({lines}, lambda x: trim(x, ' |') <> ''), "
        f"lambda x: CASE WHEN contains(x, '|') THEN {TIDY_SQL} ELSE x END), {NL})"
    )


# Pages hold no tables and only four entities, so plain replacements describe them fully.
PAGE_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'gs'), "
    f"'</?(p|div|br|h[1-6]|li|table|tbody)(\\s[^>]*)?>', {NL}, 'gi'), '<[^>]*>', '', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
)


@query("html_extract", f"SELECT page_id, text, md5(text) AS text_hash FROM (SELECT page_id, {normalise_sql(PAGE_SQL)} AS text FROM pages)")
def html_extract(spark, folder):
    pages = texts(spark, folder, "pages", "page_id", "html").select("page_id", html_to_text(F.col("html")).alias("text"))
    return pages.withColumn("text_hash", F.md5("text"))


@query("normalise_text", f"SELECT doc_id, md5({normalise_sql('text')}) AS text_hash FROM documents")
def normalise_text(spark, folder):
    return texts(spark, folder, "documents", "doc_id", "text").select("doc_id", F.md5(tx.normalise(F.col("text"))).alias("text_hash"))


@query(
    "tidy_row",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, list_transform([line], lambda x: {TIDY_SQL})[1] AS row FROM (
        SELECT *, l_returnflag || ' | | $ | ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' |  | ( | ' || l_suppkey || ' | ) | $( | ' || l_linestatus || ' |—| ' AS line FROM lineitem)""",
)
def tidy_row(spark, folder):
    """Line items laid out the way filings lay out table rows: spacers and lone symbols."""
    line = F.concat(
        F.col("l_returnflag"), F.lit(" | | $ | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" |  | ( | "),
        F.col("l_suppkey").cast("string"), F.lit(" | ) | $( | "), F.col("l_linestatus"), F.lit(" |—| "),
    )
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tx.tidy_row(line).alias("row"))


@query(
    "extraction_ratio",
    f"""SELECT page_id, round(length(text) / greatest(length(html), 1), 6) AS ratio, CAST(length(text) / greatest(length(html), 1) < 0.8 AS INTEGER) AS implausible
    FROM (SELECT page_id, html, {normalise_sql(PAGE_SQL)} AS text FROM pages)""",
)
def extraction_ratio(spark, folder):
    ratio = F.length("text") / F.greatest(F.length("html"), F.lit(1))
    pages = texts(spark, folder, "pages", "page_id", "html").select("page_id", "html", html_to_text(F.col("html")).alias("text"))
    return pages.select("page_id", F.round(ratio, 6).alias("ratio"), (ratio < 0.8).cast("int").alias("implausible"))


@query(
    "metadata_leak_scan",
    """SELECT 'leaked metadata' AS rule, CAST(page_id AS VARCHAR) AS key,
        array_to_string(list_filter(['?page=', 'track(', 'utm_'], lambda p: contains(url || html, p)), ',') AS detail
    FROM pages WHERE contains(url || html, 'track(') OR contains(url || html, 'utm_') OR contains(url || html, '?page=')""",
)
def metadata_leak_scan(spark, folder):
    found = tx.leaked_prefixes(F.concat("url", "html"), ("utm_", "track(", "?page="))
    pages = table(spark, folder, "pages").select("page_id", found.alias("found")).filter(F.size("found") > 0)
    return violations(pages, "leaked metadata", F.col("page_id"), F.array_join("found", ","))


@query("token_estimate", "SELECT doc_id, CAST(floor(length(text) / CAST(2.71 AS DOUBLE)) AS INTEGER) AS estimated_tokens FROM documents")
def token_estimate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", estimated_tokens(F.length("text")).alias("estimated_tokens"))


# --- sections -----------------------------------------------------------------------------------------

def rendered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, line_no, text): one line per event, in time order."""
    value, kind = F.col("value"), F.col("event_type")
    user = F.col("user_id").cast("string")
    text = (
        F.when(kind == "signup", F.when(value < 50, F.lit("Part I")).otherwise(F.lit("PART II — Other")))
        .when(
            kind == "error",
            F.when(value < 20, F.lit("Item 1A.")).when(value < 60, F.concat(F.lit("Item 1A. Risk Factors of "), user)).otherwise(F.lit("  ITEM 7: Management discussion")),
        )
        .when(
            kind == "purchase",
            F.when(value < 30, F.lit("Item 1. Business overview")).when(value < 60, F.lit("item 2 - Discussion and analysis")).otherwise(F.lit("Item 8 — Statements")),
        )
        .when(kind == "view", F.concat(F.lit("viewed | "), value.cast("string")))
        .otherwise(F.concat(F.lit("clicked after "), value.cast("string")))
    )
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", text.alias("text"))
    numbered = block_scan(events, ["user_id"], ["ts", "event_id"], time_block("ts"), place=Scan("position"))
    return numbered.select("user_id", (F.col("place") - 1).cast("int").alias("line_no"), "text")


def user_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n_lines")).withColumn(
        "form", F.when(F.col("user_id") % 2 == 0, F.lit("10-K")).otherwise(F.lit("10-Q"))
    )


def user_headings(spark, folder) -> DataFrame:
    return sc.heading_rows(rendered_lines(spark, folder), ["user_id"])


def user_sections(spark, folder) -> DataFrame:
    return sc.section_rows(user_headings(spark, folder), user_documents(spark, folder), ["user_id"])


SECTION_SQL = """numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS line_no FROM events),
marks AS (SELECT user_id, line_no, CASE WHEN event_type = 'signup' THEN CASE WHEN value < 50 THEN 'I' ELSE 'II' END END AS part_mark,
    CASE WHEN event_type = 'error' AND value >= 20 THEN CASE WHEN value < 60 THEN '1A' ELSE '7' END
         WHEN event_type = 'purchase' THEN CASE WHEN value < 30 THEN '1' WHEN value < 60 THEN '2' ELSE '8' END END AS item,
    CASE WHEN event_type = 'error' AND value >= 20 THEN CASE WHEN value < 60 THEN 'Item 1A. Risk Factors of ' || user_id ELSE 'ITEM 7: Management discussion' END
         WHEN event_type = 'purchase' THEN CASE WHEN value < 30 THEN 'Item 1. Business overview' WHEN value < 60 THEN 'item 2 - Discussion and analysis' ELSE 'Item 8 — Statements' END END AS heading
    FROM numbered),
headings AS (SELECT * FROM (SELECT user_id, line_no, item, heading, coalesce(last_value(part_mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line_no), '') AS part FROM marks) WHERE item IS NOT NULL),
docs AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n_lines, CASE WHEN user_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form FROM events GROUP BY user_id),
spans AS (SELECT h.*, d.n_lines, coalesce((SELECT min(g.line_no) FROM headings g WHERE g.user_id = h.user_id AND g.line_no > h.line_no AND g.item <> h.item), d.n_lines) AS end_line,
    CASE WHEN d.form = '10-K' THEN CASE item WHEN '1' THEN 'BUSINESS' WHEN '1A' THEN 'RISK_FACTORS' WHEN '7' THEN 'MDA' WHEN '8' THEN 'FINANCIAL_STATEMENTS' END
         ELSE CASE part || '/' || item WHEN 'I/1' THEN 'FINANCIAL_STATEMENTS' WHEN 'I/2' THEN 'MDA' WHEN 'II/1A' THEN 'RISK_FACTORS' END END AS name
    FROM headings h JOIN docs d ON d.user_id = h.user_id),
sections AS (SELECT user_id, name, line_no AS start_line, end_line, heading, item FROM (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY end_line - line_no DESC, line_no) AS rn
    FROM spans WHERE name IS NOT NULL) WHERE rn = 1)"""


@query("section_headings", f"WITH {SECTION_SQL} SELECT user_id, line_no, part, item, heading FROM headings")
def section_headings(spark, folder):
    return user_headings(spark, folder)


@query("section_detect", f"WITH {SECTION_SQL} SELECT user_id, name, start_line, end_line, heading, item FROM sections")
def section_detect(spark, folder):
    return user_sections(spark, folder)


@query(
    "section_tiling",
    f"""WITH {SECTION_SQL}, edged AS (SELECT *, lag(end_line, 1, 0) OVER (PARTITION BY user_id ORDER BY start_line) AS before FROM sections)
    SELECT user_id, name, start_line, end_line FROM sections
    UNION ALL SELECT user_id, 'UNSECTIONED', before, start_line FROM edged WHERE before < start_line
    UNION ALL SELECT d.user_id, 'UNSECTIONED', coalesce(max(s.end_line), 0), d.n_lines FROM docs d LEFT JOIN sections s ON s.user_id = d.user_id
        GROUP BY d.user_id, d.n_lines HAVING coalesce(max(s.end_line), 0) < d.n_lines""",
)
def section_tiling(spark, folder):
    return sc.tile_rows(user_sections(spark, folder), user_documents(spark, folder), ["user_id"])


@query(
    "section_substance",
    f"""WITH {SECTION_SQL}, wanted AS (SELECT user_id, form, unnest(CASE WHEN form = '10-Q' THEN ['FINANCIAL_STATEMENTS', 'MDA'] ELSE ['RISK_FACTORS', 'MDA', 'MARKET_RISK', 'FINANCIAL_STATEMENTS'] END) AS name FROM docs)
    SELECT w.user_id, w.name, CAST(coalesce(s.end_line - s.start_line, -1) AS INTEGER) AS n_lines FROM wanted w LEFT JOIN sections s ON s.user_id = w.user_id AND s.name = w.name
    WHERE coalesce(s.end_line - s.start_line, -1) < 12 AND NOT (w.user_id % 5 = 0 AND w.name IN ('MARKET_RISK', 'MDA'))""",
)
def section_substance(spark, folder):
    stubs = F.when(F.col("user_id") % 5 == 0, F.array(F.lit(scope.MARKET_RISK), F.lit(scope.MDA))).otherwise(F.array().cast("array<string>"))
    return sc.thin_sections(user_documents(spark, folder), user_sections(spark, folder), ["user_id"], stubs)


@query(
    "span_overlap_check",
    """WITH s AS (SELECT o_custkey, o_orderkey, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER) AS start_day,
        CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) + floor(o_totalprice / 5000) AS INTEGER) AS end_day FROM orders)
    SELECT o_custkey, o_orderkey, start_day, end_day, reached FROM (SELECT *, max(end_day) OVER (PARTITION BY o_custkey ORDER BY start_day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s)
    WHERE start_day < reached""",
)
def span_overlap_check(spark, folder):
    """Orders as spans of a customer's calendar; a span overlaps when an earlier one still runs."""
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    spans = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", start.alias("start_day"), (start + F.floor(F.col("o_totalprice") / 5000)).cast("int").alias("end_day")
    )
    return sc.overlaps(spans, ["o_custkey"], "start_day", "end_day", F.floor(F.col("start_day") / 30), "o_orderkey")


# --- chunks -------------------------------------------------------------------------------------------

CHUNK_SQL = f"""doc_lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, parts[i] AS line, length(parts[i]) + 1 AS cost, contains(parts[i], ' | ') AS tab
    FROM (SELECT doc_id, string_split(text, {NL}) AS parts, unnest(generate_series(1, len(string_split(text, {NL})))) AS i FROM documents)),
folded AS (SELECT doc_id, i, 0 AS first, cost AS buf, tab FROM doc_lines WHERE i = 0
    UNION ALL SELECT l.doc_id, l.i,
        CASE WHEN f.buf + l.cost > CASE WHEN f.tab AND l.tab THEN 2081 ELSE 1387 END THEN l.i ELSE f.first END,
        CASE WHEN f.buf + l.cost > CASE WHEN f.tab AND l.tab THEN 2081 ELSE 1387 END THEN l.cost ELSE f.buf + l.cost END, l.tab
    FROM folded f JOIN doc_lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
chunks AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS INTEGER) AS chunk_index,
        doc_id || ':' || CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 < 1000 THEN lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS VARCHAR), 4, '0')
            ELSE CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS VARCHAR) END AS chunk_id
    FROM (SELECT f.doc_id, f.first AS start_line, CAST(max(f.i) + 1 AS INTEGER) AS end_line, {strip_sql(f"string_agg(l.line, {NL} ORDER BY l.i)")} AS text
        FROM folded f JOIN doc_lines l ON l.doc_id = f.doc_id AND l.i = f.i GROUP BY f.doc_id, f.first) WHERE text <> '')"""


def chunked(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder, "documents", "doc_id", "text").select("doc_id", F.split("text", "\n").alias("lines"))
    rows = ck.chunk_rows(docs.withColumn("spans", ck.whole_span(F.col("lines"))), ["doc_id"])
    return rows.withColumn("chunk_id", ck.chunk_id(F.col("doc_id"), F.col("chunk_index")))


@query("chunk_greedy_pack", f"WITH RECURSIVE {CHUNK_SQL} SELECT doc_id, chunk_id, chunk_index, start_line, end_line, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_hash FROM chunks")
def chunk_greedy_pack(spark, folder):
    return chunked(spark, folder).select(
        "doc_id", "chunk_id", "chunk_index", "start_line", "end_line", F.length("text").alias("n_chars"), F.md5("text").alias("text_hash")
    )


@query("chunk_pack_sql", f"WITH RECURSIVE {CHUNK_SQL} SELECT doc_id, chunk_id, chunk_index, start_line, end_line, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_hash FROM chunks")
def chunk_pack_sql(spark, folder):
    """The table function, called from SQL on a table of lines."""
    chunk_udtf.register(spark)
    lines = texts(spark, folder, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    packed = spark.sql("SELECT * FROM pack_lines(TABLE({lines}) PARTITION BY doc_id ORDER BY line_no)", lines=lines)
    return packed.select(
        "doc_id", ck.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "start_line", "end_line",
        F.length("text").alias("n_chars"), F.md5("text").alias("text_hash"),
    )


@query(
    "chunk_pack_pointers",
    f"""WITH RECURSIVE every AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, string_agg(text, {NL} ORDER BY doc_id) FROM documents WHERE doc_id % 2 = 0),
    {CHUNK_SQL.replace("FROM documents)", "FROM every)")}
    SELECT doc_id, chunk_id, chunk_index, start_line, end_line, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_hash FROM chunks""",
)
def chunk_pack_pointers(spark, folder):
    """The lines of all documents, and once more those of the even ones as one document that holds a third of all lines."""
    lines = texts(spark, folder, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    sizes = lines.filter("doc_id % 2 = 0").groupBy("doc_id").agg(F.max("line_no").alias("last"))
    before = block_scan(sizes.withColumn("all", F.lit(-1)), ["all"], ["doc_id"], line_block("doc_id"), end=Scan("total", F.col("last") + 1))
    shifted = lines.join(before.select("doc_id", (F.col("end") - F.col("last") - 1).alias("shift")), "doc_id")
    one = shifted.select(F.lit(-1).cast("long").alias("doc_id"), (F.col("line_no") + F.col("shift")).alias("line_no"), "line")
    rows = cp.chunk_lines(lines.unionByName(one), "doc_id")
    return rows.select(
        "doc_id", ck.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "start_line", "end_line",
        F.length("text").alias("n_chars"), F.md5("text").alias("text_hash"),
    )


@query(
    "chunk_validity",
    f"""WITH RECURSIVE {CHUNK_SQL},
    edited AS (SELECT chunk_id, doc_id, start_line, CASE WHEN doc_id % 5 = 1 THEN end_line + 1 ELSE end_line END AS end_line,
            CASE doc_id % 5 WHEN 2 THEN 'lost' WHEN 4 THEN repeat(text, 4) ELSE text END AS text, 0 AS copy FROM chunks
        UNION ALL SELECT chunk_id, doc_id, start_line, end_line, text, 1 FROM chunks WHERE doc_id % 5 = 3 AND start_line = 0)
    SELECT 'overlaps previous chunk' AS rule, chunk_id AS key, CAST(start_line AS VARCHAR) AS detail FROM (SELECT *, max(end_line) OVER (PARTITION BY doc_id ORDER BY start_line, chunk_id, copy
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM edited) WHERE start_line < reached
    UNION ALL SELECT 'oversize', chunk_id, CAST(length(text) AS VARCHAR) FROM edited WHERE end_line - start_line > 1 AND length(text) > 2081
    UNION ALL SELECT 'table row lost', e.chunk_id, '' FROM edited e WHERE EXISTS (SELECT 1 FROM doc_lines l WHERE l.doc_id = e.doc_id AND l.i >= e.start_line AND l.i < e.end_line
        AND l.tab AND NOT contains(e.text, {strip_sql('l.line')}))
    UNION ALL SELECT 'duplicate chunk id', chunk_id, CAST(count(*) AS VARCHAR) FROM edited GROUP BY chunk_id HAVING count(*) > 1""",
)
def chunk_validity(spark, folder):
    """Real chunks with every kind of damage written in; the gate has to report exactly that."""
    good = chunked(spark, folder).select("chunk_id", "doc_id", "start_line", "end_line", "text")
    kind = F.col("doc_id") % 5
    edited = good.withColumn("end_line", F.when(kind == 1, F.col("end_line") + 1).otherwise(F.col("end_line"))).withColumn(
        "text", F.when(kind == 2, F.lit("lost")).when(kind == 4, F.repeat("text", F.lit(4))).otherwise(F.col("text"))
    )
    repeated = edited.unionByName(good.filter((kind == 3) & (F.col("start_line") == 0)))
    lines = texts(spark, folder, "documents", "doc_id", "text").select("doc_id", F.split("text", "\n").alias("lines"))
    return ck.validity_gate(repeated, lines, "doc_id")


# --- tokens -------------------------------------------------------------------------------------------

@query(
    "tokenize_terms",
    """SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_terms, md5(array_to_string(list_sort(list_distinct(t)), ' | ')) AS query_hash
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS t FROM documents)""",
)
def tokenize_terms(spark, folder):
    docs = texts(spark, folder, "documents", "doc_id", "text").select("doc_id", ANALYSERS["plain"](F.col("text")).alias("t"))
    return docs.select(
        "doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"), F.md5(tx.or_query(F.col("t"))).alias("query_hash")
    )


@query("tokenize_terms_stemmed")
def tokenize_terms_stemmed(spark, folder):
    docs = texts(spark, folder, "documents", "doc_id", "text").select("doc_id", ANALYSERS["english"](F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), tx.or_query(F.col("t")).alias("or_query"))

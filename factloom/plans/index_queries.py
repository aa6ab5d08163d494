"""Filing-index queries. Orders stand in for filings, customers and nations for entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import filings as fx
from factloom.functions.text import split_items
from factloom.operators import filing_index as ix
from factloom.operators.gates import counts_match, unique_key
from factloom.operators.lexical import metadata_filter
from factloom.plans.catalog import query, table
from factloom.sources.payloads import columnar_to_rows
from factloom.sources.tables import count_tables, new_rows

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
YEARS = (1996, 1997)
FORMS = {
    "1-URGENT": "10-K", "2-HIGH": "10-K/A", "3-MEDIUM": "10-Q", "4-NOT SPECIFIED": "10-Q/A", "5-LOW": "8-K",
}
FORM_SQL = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-K/A' WHEN '3-MEDIUM' THEN '10-Q' "
    "WHEN '4-NOT SPECIFIED' THEN '10-Q/A' ELSE '8-K' END"
)
WS_SQL = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in filing shape; orders still in process ('P') have no report date."""
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("ticker"),
        F.col("o_custkey").cast("int").alias("cik"),
        fx.mapped(FORMS, F.col("o_orderpriority")).alias("form"),
        F.col("o_orderkey").cast("string").alias("accession_no"),
        F.when(F.col("o_orderstatus") != "P", day).alias("report_date"),
        F.date_add(day, 40).alias("filing_date"),
        F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primary_document"),
        F.concat_ws(" , ", "o_orderstatus", F.lit(""), "o_orderpriority").alias("items"),
    )


def scoped(spark: SparkSession, folder: str) -> DataFrame:
    """The listing with an inline page and an overflow page that repeats the later years."""
    rows = filings(spark, folder)
    inline = rows.withColumn("page", F.lit(0))
    repeat = rows.filter(F.col("filing_date") >= "1997-01-01").withColumn("form", F.lit("10-K")).withColumn("page", F.lit(1))
    return ix.list_filings(inline.unionByName(repeat), YEARS)


@query(
    "list_filings_scope",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderkey AS VARCHAR) AS accession_no, {FORM_SQL} AS form,
        strftime(o_orderdate, '%Y-%m-%d') AS report_date, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
        CAST({FORM_SQL} LIKE '%/A' AS INTEGER) AS is_amendment,
        CAST(month(o_orderdate) = 1 AND day(o_orderdate) <= 14 AS INTEGER) AS fy_ambiguous,
        o_orderstatus || '+' || o_orderpriority AS items
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND year(o_orderdate) IN (1996, 1997)""",
)
def list_filings_scope(spark, folder):
    return scoped(spark, folder).select(
        "ticker", "accession_no", "form", F.col("report_date").cast("string").alias("report_date"), "fiscal_year",
        F.col("is_amendment").cast("int").alias("is_amendment"), F.col("fy_ambiguous").cast("int").alias("fy_ambiguous"),
        F.array_join("items", "+").alias("items"),
    )


@query(
    "fiscal_year_ambiguity",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
        CAST(month(o_orderdate) = 1 AND day(o_orderdate) <= 14 AS INTEGER) AS ambiguous FROM orders""",
)
def fiscal_year_ambiguity(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", fx.fiscal_year("o_orderdate").alias("fiscal_year"),
        fx.fiscal_year_ambiguous("o_orderdate").cast("int").alias("ambiguous"),
    )


@query(
    "fiscal_period_gate",
    f"""SELECT 'ambiguous fiscal year' AS rule, CAST(o_orderkey AS VARCHAR) AS key, {FORM_SQL} || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS detail
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND year(o_orderdate) IN (1996, 1997)
        AND month(o_orderdate) = 1 AND day(o_orderdate) <= 14
    UNION ALL SELECT 'outside fiscal years', CAST(o_orderkey AS VARCHAR), {FORM_SQL} || ' ' || strftime(o_orderdate, '%Y-%m-%d')
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND year(o_orderdate) = 1997""",
)
def fiscal_period_gate(spark, folder):
    return ix.fiscal_period_gate(scoped(spark, folder), (1996,))


@query(
    "columnar_to_rows",
    f"""SELECT o_orderkey // 1000 AS page_no, CAST(o_orderkey AS VARCHAR) AS "accessionNumber",
        strftime(o_orderdate, '%Y-%m-%d') AS "reportDate", {FORM_SQL} AS form FROM orders""",
)
def columnar(spark, folder):
    """Pages of a thousand consecutive keys, each packed into parallel arrays, then unpacked."""
    row = F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), fx.mapped(FORMS, F.col("o_orderpriority")).alias("f"))
    paged = (
        table(spark, folder, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("page_no"))
        .agg(F.array_sort(F.collect_list(row)).alias("rows"))
    )
    block = F.struct(
        F.transform("rows", lambda r: r["o_orderkey"].cast("string")).alias("accessionNumber"),
        F.transform("rows", lambda r: r["d"]).alias("reportDate"),
        F.transform("rows", lambda r: r["f"]).alias("form"),
    )
    return columnar_to_rows(
        paged.select("page_no", block.alias("block")), "block", ("accessionNumber", "reportDate", "form"), ("page_no",)
    ).drop("position")


@query(
    "resolve_keys_override",
    """SELECT c_custkey, 'NATION_' || c_nationkey AS ticker,
        CAST(CASE c_nationkey WHEN 3 THEN 903 WHEN 7 THEN 907 ELSE n_nationkey END AS INTEGER) AS cik
    FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def resolve_keys_override(spark, folder):
    asked = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("ticker"))
    known = table(spark, folder, "nation").select(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("cik"))
    return ix.resolve_keys(asked, known, {"NATION_3": 903, "NATION_7": 907})


@query(
    "interval_overlap_pruning",
    """SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS filed_from, strftime(max(o_orderdate), '%Y-%m-%d') AS filed_to
    FROM orders GROUP BY o_custkey
    HAVING strftime(max(o_orderdate), '%Y-%m-%d') >= '2000-01-01' AND strftime(min(o_orderdate), '%Y-%m-%d') <= '1995-06-30'""",
)
def interval_overlap_pruning(spark, folder):
    files = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("filed_from"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("filed_to"),
    )
    return ix.overlapping(files, "filed_from", "filed_to", "2000-01-01", "1995-06-30")


@query(
    "csv_items_parse",
    rf"""SELECT doc_id, CAST(len(items) AS BIGINT) AS n_items, md5(array_to_string(items, '~')) AS items_hash FROM (
        SELECT doc_id, list_filter(list_transform(string_split(text, ','),
            lambda x: regexp_replace(x, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')), lambda x: x <> '') AS items FROM documents)""",
)
def csv_items_parse(spark, folder):
    parsed = table(spark, folder, "documents").select("doc_id", split_items(F.col("text")).alias("items"))
    return parsed.select("doc_id", F.size("items").cast("bigint").alias("n_items"), F.md5(F.array_join("items", "~")).alias("items_hash"))


@query(
    "metadata_filter",
    """SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src7')""",
)
def metadata(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return metadata_filter(docs, lang=["en", "fr"], source=["src1", "src2", "src7"])


@query(
    "derived_strings",
    f"""SELECT o_orderkey,
        'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace(lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-' || year(o_orderdate), '-', '') || '/doc-' || o_orderkey || '.htm' AS url,
        'raw/' || o_custkey || '/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-' || year(o_orderdate) || '/doc-' || o_orderkey || '.htm' AS path,
        lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-' || year(o_orderdate) || '#' || {FORM_SQL} || '#' || o_orderkey || ':0001' AS citation
    FROM orders""",
)
def derived_strings(spark, folder):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    accession = F.concat_ws("-", F.lpad(key, 10, "0"), F.year("o_orderdate").cast("string"))
    doc = F.concat(F.lit("doc-"), key, F.lit(".htm"))
    form = fx.mapped(FORMS, F.col("o_orderpriority"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        fx.archive_url(cust, accession, doc).alias("url"),
        fx.local_path("raw/", cust, accession, doc).alias("path"),
        fx.citation(accession, form, F.concat(key, F.lit(":0001"))).alias("citation"),
    )


def _year_list(column: str) -> Column:
    return F.array_join(F.transform(column, lambda y: y.cast("string")), ",")


@query(
    "corpus_completeness",
    f"""SELECT c_custkey, CAST(count(DISTINCT y) AS INTEGER) AS n_found,
        array_to_string(list_filter([1996, 1997, 1998], lambda x: NOT list_contains(coalesce(list(y) FILTER (WHERE y IS NOT NULL), []), x)), ',') AS missing
    FROM customer LEFT JOIN (SELECT o_custkey, year(o_orderdate) AS y FROM orders
        WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) BETWEEN 1996 AND 1998) ON o_custkey = c_custkey
    GROUP BY c_custkey""",
)
def corpus_completeness(spark, folder):
    annual = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), fx.fiscal_year("o_orderdate").alias("fiscal_year"),
        fx.mapped(FORMS, F.col("o_orderpriority")).alias("form"),
    )
    gaps = ix.missing_years(table(spark, folder, "customer"), annual, "c_custkey", (1996, 1997, 1998), F.col("form") == "10-K")
    return gaps.select("c_custkey", "n_found", _year_list("missing").alias("missing"))


@query("form_histogram", f"SELECT {FORM_SQL} AS form, count(*) AS n FROM orders GROUP BY 1")
def form_histogram(spark, folder):
    return ix.form_histogram(filings(spark, folder))


@query(
    "listing_report",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS accession_no, rpad(CAST(o_custkey AS VARCHAR), 7, ' ') || rpad({FORM_SQL}, 8, ' ') || rpad(strftime(o_orderdate, '%Y-%m-%d'), 13, ' ')
        || rpad(CAST(year(o_orderdate) AS VARCHAR), 7, ' ') || rpad(strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d'), 13, ' ')
        || concat_ws(' ', CASE WHEN {FORM_SQL} LIKE '%/A' THEN 'AMENDED' END, CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) <= 14 THEN 'FY?' END) AS line
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND year(o_orderdate) IN (1996, 1997)""",
)
def listing_report(spark, folder):
    return ix.listing_report(scoped(spark, folder), "accession_no")


@query(
    "table_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
)
def table_counts(spark, folder):
    return count_tables({t: table(spark, folder, t) for t in TABLES})


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("accession_no"), F.sha2("text", 256).alias("sha256"), F.lit(True).alias("downloaded")
    )


def _fingerprint_sql(prefix: int) -> str:
    return f"""WITH e AS (SELECT CAST(doc_id AS VARCHAR) || ':' || sha256(text) || chr(10) AS entry, count(*) AS copies FROM documents GROUP BY 1),
    leaves AS (SELECT substr(sha256(entry), 1, {prefix}) AS leaf, sum(copies) AS files,
        sha256(string_agg(entry || copies, chr(10) ORDER BY entry || copies)) AS digest FROM e GROUP BY 1)
    SELECT 'tree' AS scheme, sha256(string_agg(digest, '' ORDER BY leaf)) AS fingerprint, CAST(sum(files) AS BIGINT) AS n_files FROM leaves"""


@query("corpus_fingerprint", _fingerprint_sql(4))
def corpus_fingerprint(spark, folder):
    return ix.fingerprint(_manifest(spark, folder))


@query("corpus_fingerprint_tree", _fingerprint_sql(2))
def corpus_fingerprint_tree(spark, folder):
    """The same with fewer, larger leaves."""
    return ix.fingerprint(_manifest(spark, folder), prefix=2)


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents")
def content_hash(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes")
    )


@query(
    "manifest_integrity",
    """SELECT CASE WHEN doc_id % 50 = 4 THEN 'phantom file' ELSE 'damaged file' END AS rule, CAST(doc_id AS VARCHAR) AS key,
        CASE doc_id % 50 WHEN 1 THEN 'missing file' WHEN 2 THEN 'size differs' WHEN 3 THEN 'hash differs' ELSE 'not downloaded but claims a file' END AS detail
    FROM documents WHERE doc_id % 50 IN (1, 2, 3, 4)""",
)
def manifest_integrity(spark, folder):
    """Recorded against recomputed state, with damage of every kind written into the manifest."""
    docs = table(spark, folder, "documents")
    kind = F.col("doc_id") % 50
    path = F.concat(F.lit("store/"), F.col("doc_id").cast("string"))
    disk = docs.select(path.alias("local_path"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    recorded = docs.select(
        F.col("doc_id").cast("string").alias("accession_no"),
        F.when(kind == 1, F.concat(path, F.lit(".gone"))).otherwise(path).alias("local_path"),
        (F.octet_length("text") + F.when(kind == 2, 1).otherwise(0)).cast("bigint").alias("size_bytes"),
        F.when(kind == 3, F.sha2(F.lit("edited"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"),
        (kind != 4).alias("downloaded"),
    )
    return ix.integrity_gate(recorded, disk)


@query(
    "idempotent_upsert",
    """SELECT o_orderkey, o_totalprice, 'stored' AS origin FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
    UNION ALL SELECT o_orderkey, o_totalprice + 1, 'new' FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'""",
)
def idempotent_upsert(spark, folder):
    """A stored table and an overlapping batch that also repeats its own keys."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    stored = orders.filter(F.col("o_orderdate") < "1999-01-01").select("o_orderkey", "o_totalprice", F.lit("stored").alias("origin"))
    batch = orders.filter(F.col("o_orderdate") >= "1998-01-01").select(
        "o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("new").alias("origin"), F.lit(0).alias("copy")
    )
    repeated = batch.unionByName(batch.withColumn("copy", F.lit(1)).withColumn("o_totalprice", F.lit(0.0)))
    return stored.unionByName(new_rows(repeated, stored, ["o_orderkey"], ["copy"]).drop("copy"))


@query(
    "load_reconcile",
    """SELECT 'count mismatch' AS rule, o_orderstatus || '/' || o_orderpriority AS key,
        count(*) FILTER (WHERE l_orderkey IS NOT NULL) || ' loaded, expected ' || count(*) AS detail
    FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey
    GROUP BY o_orderstatus, o_orderpriority HAVING count(*) FILTER (WHERE l_orderkey IS NOT NULL) <> count(*)""",
)
def load_reconcile(spark, folder):
    orders = table(spark, folder, "orders")
    loaded = orders.join(table(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    keys = ["o_orderstatus", "o_orderpriority"]
    n = F.count(F.lit(1)).alias("n")
    return counts_match(loaded.groupBy(*keys).agg(n), orders.groupBy(*keys).agg(n), keys)


@query(
    "duplicate_keys",
    """SELECT 'duplicate key' AS rule, l_orderkey || '/' || l_linenumber AS key, count(*) || ' rows' AS detail
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_keys(spark, folder):
    return unique_key(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "set_difference",
    "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
)
def set_difference(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey").distinct().join(lines, "o_orderkey", "left_anti")


@query(
    "orphan_anti_join",
    """SELECT 'order without lines' AS side, o_orderkey AS k, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderkey
    UNION ALL SELECT 'line without closed order', l_orderkey, count(*) FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey""",
)
def orphan_anti_join(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    # Keys of both tables are counted side by side: rows are combined before the shuffle, and nothing is sorted or joined.
    both = orders.select(F.col("o_orderkey").alias("k"), one.alias("orders"), F.when(F.col("o_orderstatus") == "F", one).otherwise(none).alias("closed"), none.alias("lines")).unionByName(
        lines.select(F.col("l_orderkey").alias("k"), none.alias("orders"), none.alias("closed"), one.alias("lines"))
    )
    counts = both.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("orders", "closed", "lines")])
    matches = F.col("k").isNotNull()  # a NULL key has no partner
    empty = F.when((F.col("orders") > 0) & ~(matches & (F.col("lines") > 0)), F.struct(F.lit("order without lines").alias("side"), "k", F.col("orders").alias("n")))
    loose = F.when((F.col("lines") > 0) & ~(matches & (F.col("closed") > 0)), F.struct(F.lit("line without closed order").alias("side"), "k", F.col("lines").alias("n")))
    return counts.select(F.explode(F.array(empty, loose)).alias("r")).filter("r is not null").select("r.side", "r.k", "r.n")

"""Fact and question queries. Line items stand in for facts: suppliers' nations give the filer,
return flag and line status the concept, the line number the unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions import filings as fx
from factloom.functions.calculator import evaluate
from factloom.functions.numeric import annual_band, exact_delta, percent_change
from factloom.operators import facts as fa
from factloom.operators import questions as qs
from factloom.operators.gates import foreign_key, union_all
from factloom.plans.catalog import query, table
from factloom.plans.index_queries import FORM_SQL, FORMS
from factloom.sources.payloads import facts_from_documents, held_facts, parse_facts

YEARS = (1996, 1997)
CONCEPTS = {
    "AF": "NetIncomeLoss", "RF": "Assets", "NO": "Revenues", "AO": "StockholdersEquity",
    "RO": "EarningsPerShareDiluted", "NF": "IncomeTaxExpenseBenefit",
}


def _case(key: str, pairs: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _ticker(key: str):
    return F.get(F.array(*[F.lit(t) for t in scope.TICKERS]), F.col(key) % len(scope.TICKERS))


def _ticker_sql(key: str) -> str:
    return "([" + ", ".join(f"'{t}'" for t in scope.TICKERS) + f"])[{key} % {len(scope.TICKERS)} + 1]"


FACTS_SQL = f"""facts AS (SELECT {_ticker_sql('s_nationkey')} AS ticker,
    {_case("l_returnflag || l_linestatus", CONCEPTS)} AS concept, CAST(l_linenumber AS VARCHAR) AS unit, l_extendedprice AS value,
    CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) - CAST(350 + l_quantity AS INTEGER) END AS period_start,
    CAST(l_shipdate AS DATE) AS period_end, CAST(l_orderkey AS VARCHAR) AS accession_no,
    CAST(l_shipdate AS DATE) + l_linenumber AS filed_date, l_partkey
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""
FILINGS_SQL = f"""filings AS (SELECT {_ticker_sql('c_nationkey')} AS ticker, {FORM_SQL} AS form, CAST(o_orderkey AS VARCHAR) AS accession_no,
    CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(o_orderdate AS DATE) AS fiscal_period
    FROM orders JOIN customer ON c_custkey = o_custkey)"""
KEY_SQL = "ticker, concept, unit, period_start, period_end"
RESOLVED_SQL = f"""resolved AS (SELECT {KEY_SQL}, arg_max(value, (filed_date, accession_no, value)) AS value,
    arg_max(accession_no, (filed_date, accession_no, value)) AS accession_no, max(filed_date) AS filed_date,
    min(value) <> max(value) AS restated FROM facts GROUP BY {KEY_SQL})"""
ANCHORED_SQL = """anchored AS (SELECT * FROM (SELECT f.*, a.fiscal_year, row_number() OVER (PARTITION BY f.ticker, f.concept, a.fiscal_year
        ORDER BY f.period_end DESC, f.unit, f.filed_date DESC, f.accession_no, f.value) AS rn
    FROM resolved f JOIN (SELECT DISTINCT ticker, fiscal_year, fiscal_period FROM filings WHERE form = '10-K') a
        ON a.ticker = f.ticker AND a.fiscal_period = f.period_end
    WHERE f.period_start IS NULL OR f.period_end - f.period_start BETWEEN 350 AND 380) WHERE rn = 1)"""
ANNUAL_SQL = """annual AS (SELECT * FROM (SELECT f.*, CAST(year(f.period_end) AS INTEGER) AS fiscal_year, row_number() OVER (
        PARTITION BY f.ticker, f.concept, year(f.period_end) ORDER BY f.period_end DESC, f.filed_date DESC, f.accession_no DESC, f.unit DESC, f.value DESC) AS rn
    FROM resolved f WHERE NOT restated AND year(f.period_end) IN (1996, 1997)
        AND NOT (month(f.period_end) = 1 AND day(f.period_end) <= 14)
        AND ((f.period_start IS NOT NULL AND f.period_end - f.period_start BETWEEN 350 AND 380) OR (f.period_start IS NULL AND EXISTS (
            SELECT 1 FROM filings a WHERE a.form = '10-K' AND a.ticker = f.ticker AND a.fiscal_period = f.period_end)))) WHERE rn = 1)"""
FACT_CTES = ",\n".join([FACTS_SQL, FILINGS_SQL, RESOLVED_SQL, ANCHORED_SQL, ANNUAL_SQL])
LABEL_SQL = _case("concept", {k: v.replace("'", "''") for k, v in scope.CONCEPT_LABELS.items() if k in CONCEPTS.values()})
QUESTIONS_SQL = f"""paired AS (SELECT b.ticker, b.concept, a.value AS prior, b.value AS now, a.accession_no AS prior_acc, b.accession_no AS now_acc, b.unit
    FROM annual a JOIN annual b ON a.ticker = b.ticker AND a.concept = b.concept AND a.fiscal_year = 1996 AND b.fiscal_year = 1997 AND a.unit = b.unit),
questions AS (
    SELECT 't1-point-' || ticker || '-' || concept || '-' || fiscal_year AS question_id, 'point' AS question_type, concept, ticker,
        'What was ' || ticker || '''s ' || {LABEL_SQL} || CASE WHEN period_start IS NULL THEN ' as of the end of' ELSE ' for' END || ' fiscal year ' || fiscal_year || '?' AS question,
        value AS expected_value, unit, CAST(0 AS DOUBLE) AS abs_tolerance, [accession_no] AS sources FROM annual
    UNION ALL SELECT 't1-chg-' || ticker || '-' || concept, 'yoy_change', concept, ticker,
        'By how much did ' || ticker || '''s ' || {LABEL_SQL} || ' change from fiscal year 1996 to fiscal year 1997? Report the absolute change.',
        CAST(CAST(now AS DECIMAL(18, 4)) - CAST(prior AS DECIMAL(18, 4)) AS DOUBLE), unit, CAST(0 AS DOUBLE), [prior_acc, now_acc] FROM paired
    UNION ALL SELECT 't1-pct-' || ticker || '-' || concept, 'yoy_pct', concept, ticker,
        'What was the percentage change in ' || ticker || '''s ' || {LABEL_SQL} || ' from fiscal year 1996 to fiscal year 1997? Report a percentage.',
        round(CAST(CAST(now AS DECIMAL(18, 4)) - CAST(prior AS DECIMAL(18, 4)) AS DOUBLE) / abs(prior) * 100.0, 2), 'percent', CAST(0.005 AS DOUBLE), [prior_acc, now_acc]
        FROM paired WHERE prior <> 0)"""


def facts(spark: SparkSession, folder: str) -> DataFrame:
    end = F.to_date("l_shipdate")
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return lines.select(
        _ticker("s_nationkey").alias("ticker"),
        fx.mapped(CONCEPTS, F.concat("l_returnflag", "l_linestatus")).alias("concept"),
        F.col("l_linenumber").cast("string").alias("unit"),
        F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_returnflag") != "N", F.date_sub(end, (F.col("l_quantity") + 350).cast("int"))).alias("period_start"),
        end.alias("period_end"),
        F.col("l_orderkey").cast("string").alias("accession_no"),
        F.date_add(end, F.col("l_linenumber")).alias("filed_date"),
    )


def filings(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    day = F.to_date("o_orderdate")
    return orders.select(
        _ticker("c_nationkey").alias("ticker"), fx.mapped(FORMS, F.col("o_orderpriority")).alias("form"),
        F.col("o_orderkey").cast("string").alias("accession_no"), fx.fiscal_year(day).alias("fiscal_year"), day.alias("fiscal_period"),
    )


def resolved(spark, folder) -> DataFrame:
    return fa.resolve_restatements(facts(spark, folder), latest=("filed_date", "accession_no", "value"))


def anchored(spark, folder) -> DataFrame:
    return fa.anchored(resolved(spark, folder), filings(spark, folder), F.col("form") == "10-K")


def annual(spark, folder) -> DataFrame:
    periods = filings(spark, folder).filter("form = '10-K'").select("ticker", F.col("fiscal_period").alias("period_end"))
    return qs.annual_facts(resolved(spark, folder), YEARS, annual_periods=periods)


def questions(spark, folder) -> DataFrame:
    return qs.build_questions(annual(spark, folder), YEARS)


def _day(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("instant")).alias(column)


@query(
    "facts_explode_semi",
    """SELECT e.event_type AS concept, 'u' || (e.user_id % 3) AS unit, e.value, CAST(e.event_id AS VARCHAR) AS accession_no,
        CASE WHEN e.event_type = 'view' THEN 'instant' ELSE strftime(e.ts - INTERVAL 90 DAY, '%Y-%m-%d') END AS period_start, strftime(e.ts, '%Y-%m-%d') AS period_end,
        CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k
    FROM events e WHERE e.event_type IN ('view', 'purchase', 'error') AND e.event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def facts_explode_semi(spark, folder):
    """Events rendered as nested facts documents (500 events each), parsed back and unfolded."""
    k = F.get_json_object("props", "$.k")
    ob = F.struct(
        F.when(F.col("event_type") != "view", F.date_format(F.date_sub(F.to_date("ts"), 90), "yyyy-MM-dd")).alias("start"),
        F.date_format("ts", "yyyy-MM-dd").alias("end"), F.col("value").alias("val"),
        F.col("event_id").cast("string").alias("accn"), k.alias("form"), F.date_format("ts", "yyyy-MM-dd").alias("filed"),
    )
    page = F.floor(F.col("event_id") / 500).alias("page")
    units = (
        table(spark, folder, "events").withColumn("unit", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))
        .groupBy(page, "event_type", "unit").agg(F.collect_list(ob).alias("obs"))
        .groupBy("page", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("unit", "obs"))).alias("units"))
        .groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("units")))).alias("concepts"))
    )
    payload = F.to_json(F.struct(F.col("page").alias("cik"), F.create_map(F.lit(scope.TAXONOMY), "concepts").alias("facts")))
    docs = units.select(F.col("page").cast("string").alias("ticker"), F.col("page").alias("cik"), parse_facts(payload).alias("doc"))
    flat = facts_from_documents(docs, ("view", "purchase", "error"))
    held = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("accession_no"))
    return held_facts(flat, held).select(
        "concept", "unit", "value", "accession_no", _day("period_start"), F.col("period_end").cast("string").alias("period_end"), F.col("form").cast("int").alias("k")
    )


@query(
    "restatement_resolution",
    """SELECT l_orderkey, l_linenumber, arg_max(l_extendedprice, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS value,
        arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_partkey,
        CAST(min(l_extendedprice) <> max(l_extendedprice) AS INTEGER) AS restated FROM lineitem GROUP BY 1, 2""",
)
def restatement_resolution(spark, folder):
    reported = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("value")
    )
    best = fa.resolve_restatements(reported, ["l_orderkey", "l_linenumber"], ("l_shipdate", "l_partkey", "l_suppkey", "value"))
    return best.select("l_orderkey", "l_linenumber", "value", "l_partkey", F.col("restated").cast("int").alias("restated"))


@query(
    "economic_fact_resolution",
    f"""WITH {FACTS_SQL}, {RESOLVED_SQL} SELECT ticker, concept, unit, coalesce(CAST(period_start AS VARCHAR), 'instant') AS period_start,
        CAST(period_end AS VARCHAR) AS period_end, value, accession_no, CAST(restated AS INTEGER) AS restated FROM resolved""",
)
def economic_fact_resolution(spark, folder):
    """Instant facts have no period start; the grouping treats those NULLs as equal."""
    return resolved(spark, folder).select(
        "ticker", "concept", "unit", _day("period_start"), F.col("period_end").cast("string").alias("period_end"),
        "value", "accession_no", F.col("restated").cast("int").alias("restated"),
    )


@query(
    "conflict_detection",
    """SELECT l_orderkey, l_linenumber, count(DISTINCT l_extendedprice) AS n_values, min(l_extendedprice) AS low, max(l_extendedprice) AS high
    FROM lineitem WHERE NOT (l_linenumber = 7 AND l_linestatus = 'F') GROUP BY l_orderkey, l_linenumber, l_linestatus
    HAVING count(DISTINCT l_extendedprice) > 1 AND max(l_extendedprice) - min(l_extendedprice) > 1e-9 * greatest(abs(max(l_extendedprice)), 1.0)""",
)
def conflict_detection(spark, folder):
    """Line 7 of finished lines is on the allowlist of known restatements."""
    reported = table(spark, folder, "lineitem").select(
        F.col("l_linenumber").cast("string").alias("ticker"), F.col("l_linestatus").alias("concept"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"),
    )
    return fa.conflicts(reported, ["ticker", "concept", "l_orderkey", "l_linenumber"], (("7", "F"),)).drop("ticker", "concept")


@query(
    "coverage_gap",
    """SELECT 'customer year' AS kind, CAST(c_custkey AS VARCHAR) AS entity, CAST(y AS VARCHAR) AS missing
        FROM (SELECT c_custkey, unnest([1995, 1996, 1997, 1998, 1999, 2000, 2001]) AS y FROM customer)
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = y)
    UNION ALL SELECT 'part concept', CAST(p_partkey AS VARCHAR), c FROM (SELECT p_partkey, unnest(['AF', 'RF', 'NO', 'AO', 'RO', 'NF']) AS c FROM part)
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag || l_linestatus = c)""",
)
def coverage_gap(spark, folder):
    seen_years = table(spark, folder, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("string").alias("concept"))
    seen_concepts = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("entity"), F.concat("l_returnflag", "l_linestatus").alias("concept"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("entity"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("entity"))
    gaps = [
        (F.lit("customer year"), fa.coverage_gaps(customers, seen_years, "entity", "concept", [str(y) for y in range(1995, 2002)])),
        (F.lit("part concept"), fa.coverage_gaps(parts, seen_concepts, "entity", "concept", list(CONCEPTS))),
    ]
    return union_all([g.select(kind.alias("kind"), F.col("entity").cast("string").alias("entity"), "missing") for kind, g in gaps])


@query(
    "annual_band_filter",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN o_orderstatus = 'P' THEN -1 ELSE date_diff('day', o_orderdate, l_shipdate) END AS INTEGER) AS days
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE o_orderstatus = 'P' OR date_diff('day', o_orderdate, l_shipdate) BETWEEN 350 AND 380""",
)
def annual_band_filter(spark, folder):
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    end = F.to_date("l_shipdate")
    return joined.filter(annual_band(start, end)).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.datediff(end, start), F.lit(-1)).alias("days")
    )


@query(
    "concept_resolution",
    f"""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'NetIncomeLoss' WHEN 'STANDARD' THEN 'StockholdersEquity'
        WHEN 'MEDIUM' THEN CASE p_size % 8 WHEN 1 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' WHEN 2 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax'
            WHEN 3 THEN 'RevenuesNetOfInterestExpense' ELSE 'Revenues' END
        WHEN 'SMALL' THEN 'PaymentsForRepurchaseOfCommonStock' WHEN 'LARGE' THEN 'Assets' ELSE '?' END AS concept FROM part""",
)
def concept_resolution(spark, folder):
    labels = {"ECONOMY": " Net Income ", "STANDARD": "Stockholders' Equity", "MEDIUM": "Top Line", "SMALL": "buybacks", "LARGE": "Assets", "PROMO": "head count"}
    return table(spark, folder, "part").select(
        "p_partkey", F.coalesce(fx.concept_of(F.lower(_ticker("p_size")), fx.mapped(labels, F.col("p_type"))), F.lit("?")).alias("concept")
    )


@query(
    "fact_lookup_anchor",
    f"""WITH {FACT_CTES} SELECT ticker, concept, fiscal_year, value, unit, CAST(period_end AS VARCHAR) AS period_end, accession_no, CAST(restated AS INTEGER) AS restated FROM anchored""",
)
def fact_lookup_anchor(spark, folder):
    return anchored(spark, folder).select(
        "ticker", "concept", "fiscal_year", "value", "unit", F.col("period_end").cast("string").alias("period_end"), "accession_no", F.col("restated").cast("int").alias("restated")
    )


@query(
    "facts_cross_enumeration",
    f"""WITH {FACT_CTES}, asked AS (SELECT n_nationkey, {_ticker_sql('n_nationkey')} AS ticker, unnest([1996, 1997, 2003]) AS fiscal_year, n_name FROM nation),
    wanted AS (SELECT asked.*, unnest(['NetIncomeLoss', CASE WHEN ticker IN ('AAPL', 'MSFT') THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' WHEN ticker = 'JPM' THEN 'RevenuesNetOfInterestExpense' ELSE 'Revenues' END, 'Assets']) AS concept FROM asked)
    SELECT n_name AS request_id, w.ticker, CAST(w.fiscal_year AS INTEGER) AS fiscal_year, w.concept, CAST(a.value IS NOT NULL AS INTEGER) AS found, coalesce(a.value, -1.0) AS value,
        CASE WHEN a.value IS NULL THEN 'no ' || w.concept || ' fact for ' || w.ticker || ' FY' || w.fiscal_year ELSE '' END AS detail
    FROM wanted w LEFT JOIN anchored a ON a.ticker = w.ticker AND a.concept = w.concept AND a.fiscal_year = w.fiscal_year""",
)
def facts_cross_enumeration(spark, folder):
    plans = table(spark, folder, "nation").select(
        F.col("n_name").alias("request_id"), F.array(_ticker("n_nationkey")).alias("tickers"),
        F.array(*[F.lit(y) for y in (1996, 1997, 2003)]).alias("fiscal_years"),
        F.array(*[F.lit(c) for c in ("net income", "Revenue", "Assets", "head count")]).alias("concepts"),
    )
    found = fa.explain_misses(fa.lookup(fa.enumerate_lookups(plans), anchored(spark, folder)), facts(spark, folder))
    return found.select(
        "request_id", "ticker", "fiscal_year", "concept", F.col("found").cast("int").alias("found"), F.coalesce("value", F.lit(-1.0)).alias("value"), "detail"
    )


@query("available_concepts", "SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus AS concept FROM lineitem")
def available_concepts(spark, folder):
    return table(spark, folder, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("concept")).distinct()


@query(
    "facts_traceable",
    """SELECT 'untraceable fact' AS rule, CAST(l_orderkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey""",
)
def facts_traceable(spark, folder):
    reported = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("accession_no"))
    held = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("accession_no"))
    return fa.traceable_gate(reported, held)


@query(
    "foreign_key_gate",
    """SELECT 'orphan' AS rule, CAST(doc_id AS VARCHAR) AS key, count(*) || ' rows' AS detail FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id""",
)
def foreign_key_gate(spark, folder):
    return foreign_key(table(spark, folder, "documents"), "doc_id", table(spark, folder, "labels"), "doc_id")


# --- questions --------------------------------------------------------------------------------------

TOTALS_SQL = """totals AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, l_returnflag || l_linestatus AS concept, year(l_shipdate) AS fy,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
paired AS (SELECT a.ticker, a.concept, a.value AS prior, b.value AS now FROM totals a JOIN totals b
    ON a.ticker = b.ticker AND a.concept = b.concept AND a.fy = 1996 AND b.fy = 1997)"""


def yearly_totals(spark, folder) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.concat("l_returnflag", "l_linestatus").alias("concept"), F.year("l_shipdate").alias("fiscal_year"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
        .withColumn("unit", F.lit("USD")).withColumn("accession_no", F.lit("total"))
    )


@query("yoy_change", f"WITH {TOTALS_SQL} SELECT ticker, concept, CAST(CAST(now AS DECIMAL(18, 4)) - CAST(prior AS DECIMAL(18, 4)) AS DOUBLE) AS change FROM paired")
def yoy_change(spark, folder):
    pairs = qs.paired_years(yearly_totals(spark, folder), 1996, 1997)
    return pairs.select("ticker", "concept", exact_delta(F.col("now.value"), F.col("prior.value")).alias("change"))


@query(
    "yoy_pct",
    f"""WITH {TOTALS_SQL} SELECT ticker, concept, round(CAST(CAST(now AS DECIMAL(18, 4)) - CAST(prior AS DECIMAL(18, 4)) AS DOUBLE) / abs(prior) * 100.0, 2) AS pct
    FROM paired WHERE prior <> 0""",
)
def yoy_pct(spark, folder):
    pairs = qs.paired_years(yearly_totals(spark, folder), 1996, 1997).filter("prior.value <> 0")
    return pairs.select("ticker", "concept", percent_change(F.col("now.value"), F.col("prior.value")).alias("pct"))


@query(
    "question_generation",
    f"""WITH {FACT_CTES}, {QUESTIONS_SQL} SELECT question_id, question_type, concept, question, expected_value, unit, abs_tolerance, array_to_string(sources, ',') AS sources FROM questions""",
)
def question_generation(spark, folder):
    return questions(spark, folder).select(
        "question_id", "question_type", "concept", "question", "expected_value", "unit", "abs_tolerance", F.array_join("source_accessions", ",").alias("sources")
    )


PRIORITY_SQL = "CASE concept " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(scope.CONCEPT_PRIORITY)) + f" ELSE {len(scope.CONCEPT_PRIORITY)} END"


@query(
    "question_frozen_set",
    f"""WITH {FACT_CTES}, {QUESTIONS_SQL} SELECT question_id, question_type FROM (SELECT *, row_number() OVER (
        PARTITION BY ticker, question_type ORDER BY {PRIORITY_SQL}, question_id) AS rn FROM questions) WHERE rn <= 2""",
)
def question_frozen_set(spark, folder):
    return qs.select_frozen(questions(spark, folder), 2).select("question_id", "question_type")


@query(
    "stratified_topn",
    """SELECT p_brand, p_type, p_partkey, rank FROM (SELECT p_brand, p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand, p_type
        ORDER BY CASE p_name WHEN 'red widget' THEN 0 WHEN 'hot ring' THEN 1 WHEN 'blue ring' THEN 2 ELSE 3 END, p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 3""",
)
def stratified_topn(spark, folder):
    from factloom.operators.scan import per_key_top

    order = [qs.priority(F.col("p_name"), ("red widget", "hot ring", "blue ring")), F.asc("p_partkey")]
    return per_key_top(table(spark, folder, "part"), ["p_brand", "p_type"], order, 3).select("p_brand", "p_type", "p_partkey", "rank")


@query(
    "grade_answers",
    f"""WITH {TOTALS_SQL}, keys AS (SELECT ticker, concept, round(CAST(CAST(now AS DECIMAL(18, 4)) - CAST(prior AS DECIMAL(18, 4)) AS DOUBLE) / abs(prior) * 100.0, 2) AS pct FROM paired)
    SELECT ticker, concept, CAST(CASE concept WHEN 'AF' THEN true WHEN 'RF' THEN true WHEN 'NO' THEN true ELSE false END AS INTEGER) AS correct FROM keys""",
)
def grade_answers(spark, folder):
    """Right, right within tolerance, right as text, wrong by a step, unparseable, and empty answers."""
    pairs = qs.paired_years(yearly_totals(spark, folder), 1996, 1997)
    keyed = pairs.select("ticker", "concept", percent_change(F.col("now.value"), F.col("prior.value")).alias("pct"))
    kind = F.col("concept")
    answer = (
        F.when(kind == "AF", F.concat(F.lit(" "), F.col("pct").cast("string")))
        .when(kind == "RF", (F.col("pct") + 0.004).cast("string"))
        .when(kind == "NO", F.lit(" up "))
        .when(kind == "AO", (F.col("pct") + 0.01).cast("string"))
        .when(kind == "RO", F.lit("about ten"))
    )
    text = F.when(kind == "NO", F.lit("UP"))
    right = qs.grade(answer, F.col("pct"), text, F.lit(0.0), F.lit(scope.PERCENT_ABS_TOLERANCE))
    return keyed.select("ticker", "concept", right.cast("int").alias("correct"))


@query(
    "question_validity",
    f"""WITH {FACT_CTES}, {QUESTIONS_SQL}
    SELECT 'duplicate question' AS rule, question_id AS key, '2' AS detail FROM questions WHERE question_type = 'yoy_change'
    UNION ALL SELECT DISTINCT 'uncitable source', question_id, s FROM (SELECT question_id, unnest(sources) AS s FROM questions)
        WHERE s NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'O')
    UNION ALL SELECT 'fails its own answer', question_id, 'NaN' FROM questions WHERE concept = 'Assets' AND question_type = 'point'
    UNION ALL SELECT 'not a number', question_id, 'NaN' FROM questions WHERE concept = 'Assets' AND question_type = 'point'""",
)
def question_validity(spark, folder):
    """The generated set with repeated change questions and undefined asset values written in."""
    good = questions(spark, folder)
    broken = good.withColumn(
        "expected_value",
        F.when((F.col("concept") == "Assets") & (F.col("question_type") == "point"), F.lit(float("nan"))).otherwise(F.col("expected_value")),
    )
    repeated = broken.unionByName(broken.filter("question_type = 'yoy_change'"))
    held = table(spark, folder, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("accession_no"))
    return qs.validity_gate(repeated, held)


@query(
    "calculator_eval",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN -1.0 WHEN 'SMALL' THEN -1.0 ELSE round((p_retailprice * p_size - 3) / 2 + p_size % 7 - (-p_size), 6) END AS value,
        CASE p_type WHEN 'PROMO' THEN 'division by zero' WHEN 'SMALL' THEN 'not allowed: Call' ELSE '' END AS error FROM part""",
)
def calculator_eval(spark, folder):
    price, size = F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")
    plain = F.format_string("(%s * %s - 3) / 2 + %s %% 7 - (-%s)", price, size, size, size)
    text = F.when(F.col("p_type") == "PROMO", F.format_string("%s / (%s - %s)", price, size, size)).when(
        F.col("p_type") == "SMALL", F.format_string("abs(%s)", price)
    ).otherwise(plain)
    out = table(spark, folder, "part").withColumn("r", evaluate(text))
    return out.select("p_partkey", F.round(F.coalesce("r.value", F.lit(-1.0)), 6).alias("value"), F.coalesce("r.error", F.lit("")).alias("error"))


@query(
    "round_robin_sample",
    """WITH d AS (SELECT source, CASE lang WHEN 'en' THEN 'RISK_FACTORS' WHEN 'fr' THEN 'MDA' WHEN 'de' THEN 'BUSINESS' ELSE 'MARKET_RISK' END AS section, doc_id,
            CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 3 ELSE 4 END AS place FROM documents d),
    o AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS off FROM (SELECT DISTINCT source FROM d)),
    r AS (SELECT d.*, row_number() OVER (PARTITION BY d.source ORDER BY (place - off + 100) % 5, doc_id) AS round FROM d JOIN o ON o.source = d.source),
    n AS (SELECT *, row_number() OVER (ORDER BY round, source) AS case_no FROM r)
    SELECT CAST(case_no AS INTEGER) AS case_no, source, section, doc_id, CASE WHEN case_no % 2 = 1
        THEN CASE section WHEN 'RISK_FACTORS' THEN 'What are the principal risks ' || source || ' disclosed for fiscal 2024?' WHEN 'MDA' THEN 'How did ' || source || ' explain its operating performance in fiscal 2024?'
            WHEN 'BUSINESS' THEN 'What products and operations does ' || source || ' describe for fiscal 2024?' ELSE 'What market risk exposures did ' || source || ' report for fiscal 2024?' END
        ELSE CASE section WHEN 'RISK_FACTORS' THEN 'Which threats to its business did ' || source || ' identify in fiscal 2024?' WHEN 'MDA' THEN 'What did ' || source || ' management say drove results in fiscal 2024?'
            WHEN 'BUSINESS' THEN 'How does ' || source || ' describe its business segments in fiscal 2024?' ELSE 'How is ' || source || ' exposed to interest rate and currency movements in fiscal 2024?' END
        END AS query FROM n WHERE case_no <= 50""",
)
def round_robin_sample(spark, folder):
    section = fx.mapped({"en": scope.RISK_FACTORS, "fr": scope.MDA, "de": scope.BUSINESS, "es": scope.MARKET_RISK}, F.col("lang"))
    sections = table(spark, folder, "documents").select("source", section.alias("section"), "doc_id")
    cases = qs.round_robin(sections, "source", "section", ["doc_id"])
    return cases.select(
        "case_no", "source", "section", "doc_id", qs.case_query(F.col("section"), F.col("source"), F.lit(2024), F.col("case_no")).alias("query")
    )

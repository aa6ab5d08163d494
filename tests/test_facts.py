"""Index, facts, questions and stored tables on literal rows."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factloom import scope
from factloom.model import FACT, FILING, MANIFEST, QUESTION
from factloom.operators import facts as fa
from factloom.operators import filing_index as ix
from factloom.operators import questions as qs
from factloom.operators.gates import GateError, enforce, unique_key
from factloom.plans import corpus
from factloom.sources import files, payloads, tables

DAY = dt.date.fromisoformat
BLOCK = {
    "accessionNumber": ["a-1", "a-2", "a-3", "a-4", "a-5", "a-1"],
    "filingDate": ["2025-02-26", "2024-02-21", "2025-02-26", "2025-05-28", "2023-02-24", "2025-02-26"],
    "reportDate": ["2025-01-26", "2024-01-28", "2025-01-26", "2025-04-27", "2023-01-29", "2025-01-26"],
    "form": ["10-K", "10-K/A", "8-K", "10-Q", "10-K", "10-Q"],
    "items": ["", "", "2.02, 9.01", "", "", ""],
    "primaryDocument": ["a.htm", "b.htm", "c.htm", "d.htm", "e.htm", "f.htm"],
}


def submissions(spark, tmp_path, recent, files_=()):
    path = tmp_path / "submissions.json"
    path.write_text(json.dumps({"cik": "1", "name": "X", "filings": {"recent": recent, "files": list(files_)}}))
    return payloads.read_submissions(spark, str(path)).select(F.lit("NVDA").alias("ticker"), F.col("cik").cast("int").alias("cik"), "filings")


def test_listing(spark, tmp_path):
    rows = ix.list_filings(payloads.listing_rows(submissions(spark, tmp_path, BLOCK), None)).orderBy("report_date").collect()
    assert [(r.accession_no, r.form, r.fiscal_year, r.is_amendment) for r in rows] == [
        ("a-2", "10-K/A", 2024, True), ("a-1", "10-K", 2025, False), ("a-4", "10-Q", 2025, False)
    ]


def test_overflow_pages_inside_the_window(spark, tmp_path):
    main = submissions(spark, tmp_path, {k: [] for k in BLOCK})
    pages = [("f1", "2023-06-01", "2024-05-01", "b-1"), ("f2", "2010-01-01", "2012-01-01", "b-2")]
    block = ", ".join(f"array('{v}') as {k}" for k, v in
                      {"accessionNumber": "ACC", "filingDate": "2024-02-16", "reportDate": "2024-12-31", "form": "10-K", "items": "", "primaryDocument": "x.htm"}.items())
    rows = [spark.sql(f"select 'JPM' ticker, 19617 cik, '{n}' name, '{a}' filingFrom, '{b}' filingTo, struct({block.replace('ACC', acc)}) block") for n, a, b, acc in pages]
    found = ix.list_filings(payloads.listing_rows(main, rows[0].union(rows[1]))).collect()
    assert [r.accession_no for r in found] == ["b-1"]


def test_ragged_blocks_raise(spark, tmp_path):
    with pytest.raises(Exception, match="ragged"):
        payloads.listing_rows(submissions(spark, tmp_path, {**BLOCK, "form": ["10-K"]}), None).collect()


def test_keys(spark):
    known = spark.createDataFrame([("XOM", 2115436), ("NVDA", 1045810)], "ticker string, cik int")
    asked = spark.createDataFrame([("xom",), ("NVDA",)], "ticker string")
    assert {r.ticker: r.cik for r in ix.resolve_keys(asked, known, scope.CIK_OVERRIDES).collect()} == {"xom": 34088, "NVDA": 1045810}
    with pytest.raises(Exception, match="NOPE"):
        ix.resolve_keys(spark.createDataFrame([("NOPE",)], "ticker string"), known, {}).collect()


def filing(ticker="NVDA", acc="a-1", form="10-K", day="2025-01-26", amended=False, ambiguous=False):
    return (ticker, 1, form, acc, DAY(day), DAY(day), DAY(day).year, "x.htm", [], amended, ambiguous)


def manifest_of(spark, *rows):
    return spark.createDataFrame([(*r, f"p/{r[3]}", "h" + r[3], 3, not r[9]) for r in rows], MANIFEST)


def test_period_and_completeness_gates(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), FILING)
    asked = spark.createDataFrame([("NVDA",)], "ticker string")
    both = frame(filing(), filing(acc="a-0", day="2024-01-28"))
    enforce(ix.fiscal_period_gate(both))
    enforce(ix.completeness_gate(asked, both))
    with pytest.raises(GateError, match="outside"):
        enforce(ix.fiscal_period_gate(frame(filing(day="2023-01-29"))))
    with pytest.raises(GateError, match="ambiguous"):
        enforce(ix.fiscal_period_gate(frame(filing(ambiguous=True))))
    with pytest.raises(GateError, match="missing 2024,2025"):
        enforce(ix.completeness_gate(asked, spark.createDataFrame([], FILING)))
    with pytest.raises(GateError, match="missing 2024"):
        enforce(ix.completeness_gate(asked, frame(filing(), filing(acc="x", form="10-K/A", day="2024-01-28", amended=True))))


def test_fingerprint(spark):
    rows = spark.createDataFrame([(f"acc{i}", hashlib.sha256(str(i).encode()).hexdigest(), i != 3) for i in range(6)], "accession_no string, sha256 string, downloaded boolean")
    leaves = {}
    for r in rows.collect():
        if r.downloaded:
            entry = f"{r.accession_no}:{r.sha256}\n"
            leaves.setdefault(hashlib.sha256(entry.encode()).hexdigest()[:4], []).append(entry + "1")
    digests = [hashlib.sha256("\n".join(sorted(e)).encode()).hexdigest() for _, e in sorted(leaves.items())]
    found = ix.fingerprint(rows).first()
    assert found.fingerprint == hashlib.sha256("".join(digests).encode()).hexdigest() and (found.scheme, found.n_files) == ("tree", 5)
    assert ix.fingerprint(rows.orderBy(F.desc("accession_no"))).first().fingerprint == found.fingerprint
    assert ix.fingerprint(rows.limit(4)).first().fingerprint != found.fingerprint


def test_integrity_against_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / "s" / name).write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    base = str(tmp_path / "s")
    rows = [("a", f"{base}/a", good, 3, True), ("b", f"{base}/b", good, 4, True), ("c", f"{base}/c", "0", 3, True), ("d", f"{base}/d", good, 3, True), ("e", "p", "", 0, False), ("f", "", "", 0, False)]
    manifest = spark.createDataFrame(rows, "accession_no string, local_path string, sha256 string, size_bytes bigint, downloaded boolean")
    found = {r.key: r.detail for r in ix.integrity_gate(manifest, files.stored_files(spark, base)).collect()}
    assert found == {"b": "size differs", "c": "hash differs", "d": "missing file", "e": "not downloaded but claims a file"}


def fact(value=1.19, acc="a-1", filed="2025-02-26", start="2023-01-30", end="2024-01-28", concept="EarningsPerShareDiluted", unit="USD", ticker="NVDA", restated=False):
    return (ticker, 1, concept, unit, float(value), DAY(start) if start else None, DAY(end), acc, "10-K", DAY(filed), restated)


def facts_of(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


SPLIT = (fact(11.93, "A", "2024-02-21"), fact(1.19, "B", "2025-02-26"))


def test_restatements(spark):
    row = fa.resolve_restatements(facts_of(spark, *SPLIT)).first()
    assert (row.value, row.restated, row.accession_no) == (1.19, True, "B")
    same = fa.resolve_restatements(facts_of(spark, fact(acc="A", filed="2024-02-21"), fact(acc="B"))).collect()
    assert len(same) == 1 and not same[0].restated
    assert fa.resolve_restatements(facts_of(spark, fact(), fact(end="2025-01-26"))).count() == 2
    instants = fa.resolve_restatements(facts_of(spark, fact(start=None), fact(2, "B", start=None))).collect()
    assert len(instants) == 1 and instants[0].restated
    assert unique_key(facts_of(spark, fact(start=None), fact(2, "B", start=None)), fa.FACT_KEY).count() == 1


def test_conflicts(spark):
    pair = facts_of(spark, *SPLIT)
    with pytest.raises(GateError, match="EarningsPerShareDiluted"):
        enforce(fa.conflict_gate(pair, allowed=()))
    enforce(fa.conflict_gate(pair))
    enforce(fa.conflict_gate(fa.resolve_restatements(pair), allowed=()))
    enforce(fa.conflict_gate(facts_of(spark, fact(1e12), fact(1e12 + 1, "B")), allowed=()))


def test_coverage_and_traceability(spark):
    asked = spark.createDataFrame([("NVDA",)], "ticker string")
    with pytest.raises(GateError, match="NVDA/NetIncomeLoss"):
        enforce(fa.coverage_gate(asked, facts_of(spark, fact()), ("NetIncomeLoss",)))
    enforce(fa.coverage_gate(asked, facts_of(spark, fact()), ("EarningsPerShareDiluted",)))
    held = spark.createDataFrame([("a-1",)], "accession_no string")
    enforce(fa.traceable_gate(facts_of(spark, fact()), held))
    with pytest.raises(GateError, match="zzz"):
        enforce(fa.traceable_gate(facts_of(spark, fact(acc="zzz")), held))


def document(concept, observations):
    return {"cik": 1, "entityName": "N", "facts": {"us-gaap": {concept: {"units": {"USD": observations}}}}}


def test_facts_documents(spark, tmp_path):
    obs = {"start": "2024-01-29", "end": "2025-01-26", "val": 72880000000, "accn": "a-1", "form": "10-K", "filed": "2025-02-26"}
    docs = [document("NetIncomeLoss", [obs, {**obs, "accn": "elsewhere"}]), document("Exotic", [obs]), document("Assets", [{k: v for k, v in obs.items() if k != "start"}]),
            document("Revenues", [obs]), document("RevenuesNetOfInterestExpense", [obs])]
    path = tmp_path / "facts.json"
    path.write_text("\n".join(json.dumps(d) for d in docs))
    raw = spark.read.text(str(path)).select(F.lit("NVDA").alias("ticker"), F.lit(1).alias("cik"), payloads.parse_facts(F.col("value")).alias("doc"))
    held = manifest_of(spark, filing())
    rows = {r.concept: r for r in corpus.build_facts(raw, held).collect()}
    assert set(rows) == {"NetIncomeLoss", "Assets", "Revenues"}
    assert rows["NetIncomeLoss"].value == 72880000000.0 and rows["Assets"].period_start is None
    assert payloads.tracked_concepts("AAPL")[-1] == "RevenueFromContractWithCustomerExcludingAssessedTax"


def test_lookup_takes_the_annual_period(spark):
    filings = spark.createDataFrame([("NVDA", 2025, DAY("2025-01-26"), "10-K"), ("NVDA", 2025, DAY("2025-10-26"), "10-Q")], "ticker string, fiscal_year int, fiscal_period date, form string")
    rows = facts_of(
        spark, fact(72.88, start="2024-01-29", end="2025-01-26", concept="NetIncomeLoss"), fact(77.1, start="2025-01-27", end="2025-10-26", concept="NetIncomeLoss"),
        fact(22.0, start="2024-10-28", end="2025-01-26", concept="NetIncomeLoss"),
    )
    anchors = fa.anchored(rows, filings, F.col("form") == "10-K")
    asked = spark.createDataFrame([("NVDA", "net income", "NetIncomeLoss", 2025), ("NVDA", "assets", "Assets", 2025)], "ticker string, label string, concept string, fiscal_year int")
    got = {r.concept: r for r in fa.explain_misses(fa.lookup(asked, anchors), rows).collect()}
    assert got["NetIncomeLoss"].value == 72.88 and not got["Assets"].found
    assert got["Assets"].available_concepts == ["NetIncomeLoss"] and "no Assets fact" in got["Assets"].detail


def two_years(**kw):
    return fact(29_760e6, "k-24", start="2023-01-30", end="2024-01-28", **kw), fact(72_880e6, "k-25", start="2024-01-29", end="2025-01-26", **kw)


def built(spark, *rows, years=(2024, 2025), **kw):
    return qs.build_questions(qs.annual_facts(facts_of(spark, *rows), years, **kw), years)


def test_questions(spark):
    rows = {r.question_type: r for r in built(spark, *two_years(concept="NetIncomeLoss")).orderBy("question_id").collect()}
    assert rows["yoy_change"].expected_value == 43_120e6 and rows["yoy_change"].source_accessions == ["k-24", "k-25"]
    assert rows["yoy_pct"].expected_value == 144.89 and rows["yoy_pct"].question_id == "t1-pct-NVDA-NetIncomeLoss"
    assert rows["point"].question == "What was NVDA's net income for fiscal year 2025?"
    assert built(spark, *two_years(restated=True)).isEmpty()
    assert built(spark, fact(start="2024-10-27", end="2025-01-26")).isEmpty()
    assert built(spark, fact(start="2024-01-29", end="2025-02-02"), years=(2025,)).count() == 1
    assert "as of the end of" in built(spark, fact(start=None, end="2025-01-26", concept="Assets")).first().question
    zero = (fact(0, "k-24", start="2023-01-30", end="2024-01-28"), two_years()[1])
    assert {r.question_type for r in built(spark, *zero).collect()} == {"point", "yoy_change"}


def test_quarter_end_instants(spark):
    """Balance figures of a quarter end answer annual questions only in strict parity."""
    rows = (fact(100, start=None, end="2025-01-26", concept="Assets"), fact(150, start=None, end="2025-10-26", concept="Assets"))
    periods = spark.createDataFrame([("NVDA", DAY("2025-01-26"))], "ticker string, period_end date")
    assert built(spark, *rows, annual_periods=periods).first().expected_value == 100
    assert built(spark, *rows, annual_periods=periods, strict_parity=True).first().expected_value == 150


def test_frozen_set_is_balanced(spark):
    pool = built(spark, *two_years(), *two_years(ticker="AAPL"), *two_years(concept="Revenues"))
    chosen = qs.select_frozen(pool, 1).collect()
    assert len(chosen) == 6 and {r.concept for r in chosen if r.tickers == ["NVDA"]} == {"Revenues"}


@pytest.mark.parametrize(
    ("answer", "number", "text", "absolute", "right"),
    [("72880000000", 72_880e6, None, 0.0, True), ("72880000001", 72_880e6, None, 0.0, False), (" nvda ", None, "NVDA", 0.0, True), ("no idea", 1.0, None, 0.0, False),
     ("28.5012", 28.5, None, 0.005, True), ("28.51", 28.5, None, 0.005, False), (None, 1.0, None, 0.0, False), ("NaN", 1.0, None, 9e9, False)],
)
def test_grading(spark, answer, number, text, absolute, right):
    row = spark.createDataFrame([(answer, number, text)], "a string, n double, t string")
    graded = row.select(qs.grade(F.col("a"), F.col("n"), F.col("t"), F.lit(0.0), F.lit(absolute)).alias("g"))
    assert graded.first().g is right


def test_question_gate_and_files(spark, tmp_path):
    pool = built(spark, *two_years())
    held = spark.createDataFrame([("k-24",), ("k-25",)], "accession_no string")
    enforce(qs.validity_gate(pool, held))
    for broken, rule in ((pool.union(pool), "duplicate"), (pool.withColumn("abs_tolerance", F.lit(-1.0)).withColumn("rel_tolerance", F.lit(-1.0)), "own answer"), (pool.withColumn("source_accessions", F.array(F.lit("zz"))), "uncitable")):
        with pytest.raises(GateError, match=rule):
            enforce(qs.validity_gate(broken, held))
    text = pool.limit(1).withColumn("expected_value", F.lit(None).cast("double")).withColumn("expected_text", F.lit("NVDA")).withColumn("question_id", F.lit("z"))
    files.write_questions(pool, str(tmp_path / "q"))
    assert sorted(files.read_questions(spark, str(tmp_path / "q")).collect()) == sorted(pool.select(*QUESTION.fieldNames()).collect())
    (tmp_path / "t.jsonl").write_text(json.dumps({"question_id": "z", "expected_value": "NVDA"}))
    assert files.read_questions(spark, str(tmp_path / "t.jsonl")).first().expected_text == "NVDA" and text.count() == 1


def test_manifest_and_case_files(spark, tmp_path):
    manifest = manifest_of(spark, filing(), filing(ticker="AAPL", acc="a-9"))
    files.write_manifest(manifest, str(tmp_path / "m"))
    assert sorted(files.read_manifest(spark, str(tmp_path / "m")).collect()) == sorted(manifest.collect())
    cases = spark.createDataFrame([("c1", "q", [("a-1", "MDA")], ["NVDA"], [2025])], "query_id string, query string, relevant array<struct<accession_no:string,item_section:string>>, tickers array<string>, fiscal_years array<int>")
    files.write_cases(cases, str(tmp_path / "c"))
    back = files.read_cases(spark, str(tmp_path / "c"))
    assert back.collect() == cases.collect() and files.relevant_pairs(back).first().item_section == "MDA"


def test_round_robin_starts_each_key_elsewhere(spark):
    rows = [(t, s, y) for t in ("A", "B", "C") for s in scope.SECTION_ORDER for y in (2024, 2025)]
    got = qs.round_robin(spark.createDataFrame(rows, "t string, s string, y int"), "t", "s", ["y"], target=7).orderBy("case_no").collect()
    assert [(r.t, r.s, r.y) for r in got[:4]] == [("A", "RISK_FACTORS", 2024), ("B", "MDA", 2024), ("C", "FINANCIAL_STATEMENTS", 2024), ("A", "RISK_FACTORS", 2025)]
    assert [r.case_no for r in got] == list(range(1, 8))


def test_idempotent_tables(spark):
    corpus.create_tables(spark)
    rows = facts_of(spark, fact(start=None), fact(2, "B", start=None), fact(3, end="2025-01-26"))
    for _ in range(2):
        tables.append_new(spark, "facts", rows, ["value"])
    assert sorted(r.value for r in spark.table("facts").collect()) == [1.19, 3.0]
    corpus.create_tables(spark)
    assert spark.table("facts").count() == 2


def test_corpus_build(spark, tmp_path):
    body = "".join(f"<p>Item {i}. A titled heading</p>" + "<p>Body text of it.</p>" * 15 for i in ("1", "1A", "7", "7A", "8"))
    (tmp_path / "a.htm").write_bytes(f"<html>{body}</html>".encode() + b"\xff")
    manifest = manifest_of(spark, filing()).withColumn("local_path", F.lit(f"{tmp_path}/a.htm"))
    pages = files.html_pages(spark, str(tmp_path))
    chunks = corpus.build_chunks(manifest, pages, gates=("text", "sections", "chunks"))
    assert {r.item_section for r in chunks.collect()} == set(scope.SECTION_ORDER)
    leaky = pages.withColumn("html", F.lit("<p>us-gaap:Leak</p>"))
    with pytest.raises(GateError, match="us-gaap:"):
        corpus.build_chunks(manifest, leaky)
    thin = pages.withColumn("html", F.concat(F.lit("<p>x</p><!--"), F.repeat(F.lit("y"), F.lit(9000)), F.lit("-->")))
    with pytest.raises(GateError, match="short"):
        corpus.build_chunks(manifest, thin)
    with pytest.raises(GateError, match="thin section"):
        corpus.build_chunks(manifest, pages.withColumn("html", F.lit("<p>Item 7. Discussion here</p><p>See page 9.</p>")), gates=("sections",))


def test_retrieval_cases(spark):
    from factloom.plans.retrieval_eval import build_cases

    titles = {"1": "Business", "1A": "Risk Factors", "7": "Discussion", "7A": "Market Risk", "8": "Statements"}
    text = "\n".join(line for i, t in titles.items() for line in (f"Item {i}. {t}", *["Body."] * 14))
    rows = [(f"{t}-{y}", t, "10-K", y, text) for t in ("AAPL", "COST", "JPM") for y in (2024, 2025)] + [("q", "AAPL", "10-Q", 2024, text)]
    filings = spark.createDataFrame(rows, "accession_no string, ticker string, form_type string, fiscal_year int, text string")
    cases = build_cases(filings, 6).orderBy("query_id").collect()
    assert [c.query_id for c in cases[:3]] == ["r-001-AAPL-RISK_FACTORS-2024", "r-002-COST-MDA-2024", "r-003-JPM-BUSINESS-2024"]
    assert cases[0].query == "What are the principal risks Apple disclosed for fiscal 2024?"
    assert cases[2].query == "What products and operations does JPMorgan Chase describe for fiscal 2024?" and cases[2].relevant[0].accession_no == "JPM-2024"
    full = build_cases(filings, 50).collect()
    assert len(full) == 10 + 10 + 4 and not any("JPM-MDA" in c.query_id for c in full)

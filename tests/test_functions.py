

import pytest
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions import filings as fx
from factloom.functions import numeric as nm
from factloom.functions import text as tx
from factloom.functions.calculator import calculate, evaluate
from factloom.functions.markup import html_to_text
from factloom.functions.stemming import lexemes, stem
from factloom.functions.vectors import hashing_encoder, l2_normalise, require_dimension


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


HEADER = (
    '<ix:header><ix:hidden><ix:nonNumeric contextRef="c-1">0001 us-gaap:Level2Member</ix:nonNumeric></ix:hidden>'
    "<div><xbrli:context>0001</xbrli:context></div></ix:header>"
)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<html><body>{HEADER}<p>Item 7. MD&amp;A</p></body></html>", "Item 7. MD&A"),
        ("<ix:header><div><span>dei:Key</span></div></ix:header><p>Revenue rose.</p>", "Revenue rose."),
        ("<style>.x{}</style><script>var a='</p>';</script><p>Net income</p>", "Net income"),
        ("<table><tr><td>Revenue</td><td>130</td></tr>\n <tr><td>Cost</td><td>32</td></tr></table>", "Revenue | 130\nCost | 32"),
        ("<table><tr><td>Profit</td><td>97</td><td></td><td> </td><td>44</td></tr></table>", "Profit | 97 | 44"),
        ("<table><tr><td>Net</td><td>$</td><td>72</td><td></td><td>$</td><td>29</td></tr></table>", "Net | $72 | $29"),
        ("<table><tr><td>Net</td><td>—</td><td></td><td>4</td></tr></table>", "Net | — | 4"),
        ("<div><p>One</p><p>Two</p></div>", "One\nTwo"),
        ("<p>Item&#160;7.&nbsp;MD&amp;A</p>", "Item 7. MD&A"),
        ("<p><b>A</b> <b>B</b></p>", "AB"),  # white-space-only pieces are dropped
        ("<tr><td><div>x</div></td><td>y</td></tr>", "x\ny"),  # a block inside a cell breaks the row
        ("", ""),
    ],
)
def test_html(spark, html, text):
    assert one(spark, html_to_text(F.col("h")), h=html) == text


def test_tidy_row_is_no_fold_over_cells(spark):
    """F8: the cells of a row, glued one after another, against one expression for the whole line."""
    import random

    rng = random.Random(5)
    parts = ["|", "|", "|", " ", " ", "$", "(", "$(", "5", "x y", ")", "\u00a0", "\n", "a$", "\\", "—"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(3000)] + ["$|(|$(|$|5", "", "|", None]

    def tidied(line):
        cells = []
        for cell in (c.strip("\t\n\x0b\f\r \u00a0") for c in line.split("|")):
            if cell and cells and cells[-1] in ("$", "(", "$("):
                cells[-1] += cell
            elif cell:
                cells.append(cell)
        return " | ".join(cells)

    rows = spark.createDataFrame([(x,) for x in lines], "r string").select("r", tx.tidy_row(F.col("r")).alias("t"))
    assert [r.t for r in rows.collect() if r.r is not None and r.t != tidied(r.r)] == []
    assert "lambda" not in rows._jdf.queryExecution().executedPlan().toString()


def test_tidy_row_glues_lone_symbols(spark):
    row = "Loss | | $( | 12 | ) | ( | 3 | $ | $ | 5 "
    assert one(spark, tx.tidy_row(F.col("r")), r=row) == "Loss | $(12 | ) | (3 | $$ | 5"


def test_normalise_drops_blank_and_pipe_only_lines(spark):
    assert one(spark, tx.normalise(F.col("t")), t=" a \xa0 b \n | | \n\t\nc") == "a b\nc"


def test_split_items(spark):
    assert one(spark, tx.split_items(F.col("t")), t=" 2.02 ,, 9.01,") == ["2.02", "9.01"]
    assert one(spark, tx.split_items(F.lit(None).cast("string"))) == []


def test_leaks(spark):
    assert one(spark, tx.leaked_prefixes(F.col("t")), t="Revenue us-gaap:X dei:Y") == ["dei:", "us-gaap:"]


@pytest.mark.parametrize(
    ("word", "root"),
    [("revenues", "revenu"), ("policies", "polici"), ("operating", "oper"), ("disclosed", "disclos"), ("national", "nation"),
     ("happily", "happili"), ("dying", "die"), ("knightly", "knight"), ("generations", "generat"), ("news", "news"), ("controlling", "control")],
)
def test_stem(word, root):
    assert stem(word) == root


def test_lexemes_drop_stop_words(spark):
    assert one(spark, lexemes(F.col("t")), t="What are the principal risks of 2024?") == ["princip", "risk", "2024"]
    rows = spark.createDataFrame([("",), ("the",), ("Risks rose",)], "t string").select(lexemes(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [[], [], ["risk", "rose"]]


@pytest.mark.parametrize(
    ("expression", "value"), [("2 + 3 * 4", 14.0), ("(72880-29760)/29760*100", 144.8924731182796), ("-2 ** 2", -4.0), ("7 % 4", 3.0), ("+5", 5.0)]
)
def test_calculator(expression, value):
    assert calculate(expression) == (pytest.approx(value), None)


@pytest.mark.parametrize(
    "expression",
    ["__import__('os').system('id')", "open('x')", "a + 1", "[1,2]", "True + 1", "'a' * 3", "1 / 0", "1 +", "", "9" * 201, "(1).real", "(-8) ** 0.5", "1e308 ** 9", "lambda: 1"],
)
def test_calculator_refuses(expression):
    value, problem = calculate(expression)
    assert value is None and problem


def test_calculator_column(spark):
    rows = spark.createDataFrame([("1+1",), ("1/0",), (None,)], "e string").select(evaluate("e").alias("r")).collect()
    assert rows[0].r.value == 2.0 and rows[1].r.error == "division by zero" and rows[2].r.value is None


def test_exact_delta(spark):
    assert one(spark, nm.exact_delta(F.lit(2.97), F.lit(1.32))) == 1.65
    assert one(spark, nm.exact_delta(F.lit(7.09), F.lit(5.71))) == 1.38
    assert one(spark, nm.exact_delta(F.lit(72_880_000_000.0), F.lit(29_760_000_000.0))) == 43_120_000_000.0


def test_percent_change(spark):
    assert one(spark, nm.percent_change(F.lit(72880.0), F.lit(29760.0))) == 144.89
    assert one(spark, nm.percent_change(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, nm.percent_change(F.lit(1.0), F.lit(-4.0))) == 125.0


def test_token_estimate(spark):
    assert one(spark, nm.estimated_tokens(F.lit(1387))) == 511


def test_fiscal_year(spark):
    days = {"2025-01-26": (2025, False), "2024-09-28": (2024, False), "2025-01-03": (2025, True), "2025-01-14": (2025, True), "2025-01-15": (2025, False)}
    for day, want in days.items():
        date = F.lit(day).cast("date")
        row = spark.range(1).select(fx.fiscal_year(date).alias("y"), fx.fiscal_year_ambiguous(date).alias("a")).first()
        assert (row.y, row.a) == want


def test_concepts(spark):
    resolve = lambda t, c: one(spark, fx.concept_of(F.lit(t), F.lit(c)))
    assert resolve("jpm", "Revenue") == "RevenuesNetOfInterestExpense"
    assert resolve("AAPL", " Total Revenue ") == "RevenueFromContractWithCustomerExcludingAssessedTax"
    assert resolve("ACME", "revenue") is None
    assert resolve("NVDA", "Stockholders' Equity") == "StockholdersEquity"
    assert resolve("NVDA", "Assets") == "Assets" and resolve("NVDA", "assets") == "Assets"
    assert resolve("NVDA", "headcount") is None


def test_claim_year(spark):
    year = lambda p: one(spark, fx.claim_year(F.lit(p).cast("string"), F.lit(2025)))
    assert year("FY2024") == 2024 and year("fiscal 2019, then 2024 and 2025") == 2024
    assert year("120249") == 2025 and year(None) == 2025


def test_archive_url(spark):
    url = one(spark, fx.archive_url(F.lit(1045810), F.lit("0001045810-25-000023"), F.lit("d.htm")))
    assert url == "https://www.sec.gov/Archives/edgar/data/1045810/000104581025000023/d.htm"


def test_vectors(spark):
    assert one(spark, l2_normalise(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, l2_normalise(F.array(F.lit(0.0)))) == [0.0]
    with pytest.raises(Exception, match="expected 3"):
        one(spark, require_dimension(F.array(F.lit(1.0)), 3))
    encode = hashing_encoder(16)
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],)], "t array<string>").select(encode("t").alias("v")).collect()
    assert sum(x * x for x in rows[0].v) == pytest.approx(1.0) and rows[1].v == [0.0] * 16


def test_scope_is_consistent():
    assert set(scope.REVENUE_CONCEPT_BY_TICKER) == set(scope.TICKERS) == set(scope.COMPANY_NAMES)
    assert (scope.TARGET_CHARS, scope.MAX_CHARS) == (1387, 2081)
    assert len(scope.CORE_CONCEPTS) == 17 and "GrossProfit" not in scope.CORE_CONCEPTS


def test_stop_words_are_looked_up_once_per_distinct_token(spark):
    """no scan of the stop words for every token; rows without a token keep their place."""
    from factloom.functions.stemming import lexemes

    data = [(1, "the running of the dogs"), (2, None), (3, "The AND of"), (4, ""), (5, "dogs, the 10 dogs")]
    found = spark.createDataFrame(data, "i int, t string").coalesce(1).select("i", lexemes(F.col("t")).alias("x"))
    assert [r.x for r in sorted(found.collect())] == [["run", "dog"], [], [], [], ["dog", "10", "dog"]]
    assert "array_contains" not in found._jdf.queryExecution().executedPlan().toString()

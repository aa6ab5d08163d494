"""What a query reads, keeps and shuffles, where results alone would not show it."""

from pyspark.sql import functions as F

from factloom.functions.text import strip
from factloom.operators import chunks as ck
from factloom.operators import lexical as lx
from factloom.plans.registered import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def counted(df, column, counter):
    """``df`` with a column that counts how often it is computed."""

    @F.udf("string")
    def same(value):
        counter.add(1)
        return value

    return df.withColumn(column, same(F.col(column)))


def test_bm25_reads_texts_once(spark):
    made = spark.sparkContext.accumulator(0)
    docs = counted(spark.createDataFrame([(1, "red fox"), (2, "blue fox fox"), (3, None)], "id int, text string"), "text", made)
    found = lx.lexical_search(docs, spark.createDataFrame([(7, "fox red")], "query_id int, query string"), 2, scorer="bm25")
    assert [r.id for r in sorted(found.collect(), key=lambda r: r.rank)] == [1, 2] and made.value == 3


def test_orphans_without_join_and_with_null_keys(spark, tmp_path):
    spark.createDataFrame([(1, "F"), (1, "O"), (2, "O"), (3, "F"), (None, "F")], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1,), (2,), (2,), (4,), (None,)], "l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["orphan_anti_join"](spark, str(tmp_path))
    got = {(r.side, r.k, r.n) for r in found.collect()}
    assert got == {("order without lines", 3, 1), ("order without lines", None, 1), ("line without closed order", 2, 2), ("line without closed order", 4, 1), ("line without closed order", None, 1)}
    assert "Join" not in plan(found) and "Sort" not in plan(found)


def test_replanned_answers_make_chunks_and_anchors_once(spark):
    from factloom.plans.answering import answer, extractive_drafter

    row = ("n25:0000", "n25", "NVDA", 2025, "MDA", "NVIDIA revenue grew to $130.5 billion.")
    chunks = spark.createDataFrame([row], "chunk_id string, accession_no string, ticker string, fiscal_year int, item_section string, text string")
    anchors = spark.createDataFrame([("NVDA", "Revenues", 2025, 130497.0, "USD", "n25")], "ticker string, concept string, fiscal_year int, value double, unit string, accession_no string")
    anchors = anchors.withColumn("period_end", F.to_date(F.lit("2025-01-26"))).withColumn("restated", F.lit(False))
    made, looked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    ask = spark.createDataFrame([(1, "What was NVIDIA revenue in 2025?")], "request_id int, question string")
    memo = answer(
        ask, counted(chunks, "text", made), counted(anchors, "unit", looked),
        drafter=lambda *tables: extractive_drafter(*tables).withColumn("value", F.col("value") * 2),
    ).first()
    assert memo.replans == 3 and memo.n_unverified == 1
    assert (made.value, looked.value) == (1, 1)


def test_documents_without_text_have_no_chunks(spark):
    docs = spark.createDataFrame([(1, None), (2, ["a", " "]), (3, [])], "doc_id int, lines array<string>").withColumn("spans", ck.whole_span(F.col("lines")))
    assert [(r.doc_id, r.start_line, r.end_line, r.text) for r in ck.chunk_rows(docs, ["doc_id"]).collect()] == [(2, 0, 2, "a")]


def test_strip_takes_all_white_space_from_the_ends_only(spark):
    space = "\t\n\x0b\f\r\x1c\x1f \x85\xa0       　"
    row = spark.createDataFrame([(f"{space}a{space}​b{space}", space)], "x string, y string").select(strip(F.col("x")).alias("x"), strip(F.col("y")).alias("y")).first()
    assert (row.x, row.y) == (f"a{space}​b", "")


def test_retrieve_reads_texts_once_for_both_kinds(spark):
    from factloom.operators.fusion import retrieve

    made = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, "blue fox", [0.0, 1.0])], "id int, text string, embedding array<double>")
    asked = spark.createDataFrame([(7, "red", [1.0, 0.0]), (8, "blue", None)], "query_id int, query string, vector array<double>")
    found = retrieve(counted(docs.drop("embedding"), "text", made), docs.drop("text"), asked, 1).collect()
    assert {(r.query_id, r.id, r.mode) for r in found} == {(7, 1, "hybrid"), (8, 2, "lexical")} and made.value == 2

"""Chunking as a table function in SQL."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import chunk_udtf
from factloom.operators.chunks import chunk_rows, whole_span
from tests.test_chunk_pointers import made


def test_pack_lines_cuts_as_chunk_rows_does(spark):
    docs = {1: made(1, 300), 2: made(2, 80, 0.3), 3: ["", "  ", ""], 4: ["one"]}
    table = spark.createDataFrame(list(docs.items()), "doc long, lines array<string>")
    want = chunk_rows(table.withColumn("spans", whole_span(F.col("lines"))), ["doc"]).select("doc", "chunk_index", "start_line", "end_line", "text")
    chunk_udtf.register(spark)
    lines = table.select("doc", F.posexplode("lines").alias("line_no", "line"))
    got = spark.sql("SELECT * FROM pack_lines(TABLE({lines}) PARTITION BY doc ORDER BY line_no)", lines=lines)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT * FROM pack_lines(TABLE({lines}) PARTITION BY doc ORDER BY line_no)", lines=lines.limit(0)).isEmpty()
    with pytest.raises(Exception, match="pack_lines takes"):
        spark.sql("SELECT * FROM pack_lines(TABLE({lines}) PARTITION BY doc ORDER BY line)", lines=lines.drop("line_no"))

"""Chunking as a SQL table function: lines come in order, one after another, and only the open chunk is kept.

    SELECT * FROM pack_lines(TABLE(lines) PARTITION BY doc_id ORDER BY line_no)

A document lies in one task, in constant memory; ``operators.chunk_pointers`` spreads a document over tasks instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from factloom import scope
from factloom.functions.text import SPACE

ENDS = re.compile(f"^{SPACE}+|{SPACE}+$")
NEEDED = ("line_no", "line")


class PackLines:
    """Lines (a document column, line_no, line) to (document column, chunk_index, start_line, end_line, text), as ``chunks.pack`` cuts them."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.key = analyzed.schema[0].name if analyzed else None
        self.document, self.lines, self.size, self.tabular = None, [], 0, False
        self.start = self.index = 0

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("pack_lines takes a table")
        columns = table.dataType.fields
        missing = [c for c in NEEDED if c not in [f.name for f in columns]]
        others = [f for f in columns if f.name not in NEEDED]
        if missing or len(others) != 1:
            raise ValueError("pack_lines takes line_no, line and one column that names the document")
        number = [StructField(n, IntegerType()) for n in ("chunk_index", "start_line", "end_line")]
        return AnalyzeResult(schema=StructType([others[0], *number, StructField("text", StringType())]))

    def _chunk(self, end: int) -> Iterator[tuple]:
        text = ENDS.sub("", "\n".join(self.lines))
        if text:
            yield self.document, self.index, self.start, end, text
            self.index += 1

    def eval(self, row: Row) -> Iterator[tuple]:
        line = row["line"] or ""
        cost, tabular = len(line) + 1, scope.CELL_SEPARATOR in line
        limit = scope.MAX_CHARS if self.tabular and tabular else scope.TARGET_CHARS
        if self.lines and self.size + cost > limit:
            yield from self._chunk(row["line_no"])
            self.lines, self.size = [], 0
        if not self.lines:
            self.start = row["line_no"]
        self.document, self.tabular = row[self.key], tabular
        self.lines.append(line)
        self.size += cost
        self.end = row["line_no"] + 1

    def terminate(self) -> Iterator[tuple]:
        if self.lines:
            yield from self._chunk(self.end)


def register(spark: SparkSession, name: str = "pack_lines") -> None:
    spark.udtf.register(name, udtf(PackLines))

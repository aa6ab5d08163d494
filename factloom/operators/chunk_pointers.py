"""Greedy packing of lines into chunks where one document may hold a large share of all lines.

``chunks.chunk_rows`` packs a document inside its row, as a fold. Here lines are rows. Where a chunk that begins at a line ends depends on the next ``MAX_CHARS`` lines at most, for every line costs
a character; so each block of lines, with that many more behind it, gives every line the pointer to the start that would follow it: binary searches in the block's prefix
sums. Doubling the pointers leads from every line at which the block can be entered to the start it is left at. These maps, one row a block, are followed along the document;
then each block, knowing where it is entered, walks its own starts. Texts move only when lines meet the chunk they belong to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom import scope
from factloom.functions.text import is_table_row, strip
from factloom.operators.scan import Scan, block_scan, line_block
from factloom.session import cut_lineage

BLOCK_LINES = 1 << 14
_SECTION = "__section"


def next_starts(lengths: np.ndarray, tabular: np.ndarray, section: np.ndarray, n_own: int) -> np.ndarray:
    """For each of the first ``n_own`` lines, the line that would start the chunk after one that starts there."""
    n = len(lengths)
    total = np.append(0, np.cumsum(lengths + 1))
    here = np.arange(n_own)

    def first_beyond(limit: int) -> np.ndarray:
        return np.maximum(np.searchsorted(total[1:], total[here] + limit, side="right"), here + 1)

    def at_or_after(marked: np.ndarray) -> np.ndarray:
        """The first marked line from each line on; n where there is none."""
        return np.append(np.minimum.accumulate(np.where(marked, np.arange(n), n)[::-1])[::-1], n)

    goes_on = np.append(False, tabular[1:] & tabular[:-1])  # a table row after a table row may run on to the larger limit
    breaks = np.append(False, section[1:] != section[:-1])
    ordinary = at_or_after(~goes_on)[np.minimum(first_beyond(scope.TARGET_CHARS), n)]
    return np.minimum.reduce([ordinary, first_beyond(scope.MAX_CHARS), at_or_after(breaks)[here + 1], np.full(n_own, n)])


def left_at(pointers: np.ndarray) -> np.ndarray:
    """From each line, the first start behind the block, by doubling the pointers."""
    to = pointers.copy()
    while True:
        inside = np.flatnonzero(to < len(to))
        if not len(inside):
            return to
        to[inside] = to[to[inside]]


def _maps(key: str, block_lines: int, halo: int, arrow: pa.Schema):
    def run(lines: pa.Table) -> pa.Table:
        lines = lines.sort_by("line_no").combine_chunks()
        number, block = lines.column("line_no").to_numpy(), lines.column("block")[0].as_py()
        n_own = int(np.searchsorted(number, (block + 1) * block_lines))
        section = lines.column(_SECTION).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        pointers = next_starts(lines.column("length").to_numpy().astype(np.int64), lines.column("tabular").to_numpy(zero_copy_only=False), section, n_own)
        exits = left_at(pointers)[: min(halo, n_own)]
        return pa.table(
            [lines.column(key).slice(0, 1), pa.array([block]), *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (pointers, exits))], schema=arrow,
        )

    return run


def _entered(key: str, block_lines: int, arrow: pa.Schema):
    """Blocks sorted along each document: the line each is entered at, counted from its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, entry = None, 0
        for batch in batches:
            entries = []
            for name, block, to in zip(batch.column(key).to_pylist(), batch.column("block").to_pylist(), batch.column("exits").to_pylist()):
                if not block:
                    document, entry = name, 0
                exits = np.frombuffer(to, np.int32)
                entries.append(entry)
                # A document that ends before the entry has no start here.
                entry = int(exits[entry]) - block_lines if entry < len(exits) else entry - block_lines
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("block"), pa.array(entries, pa.int64())], schema=arrow)

    return run


def _walked(key: str, block_lines: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, (block, entry, held) in enumerate(zip(batch.column("block").to_pylist(), batch.column("entry").to_pylist(), batch.column("pointers").to_pylist())):
                pointers, base = np.frombuffer(held, np.int32).tolist(), block * block_lines
                while entry < len(pointers):
                    rows.append(i)
                    starts.append(base + entry)
                    entry = pointers[entry]
                    ends.append(base + entry)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=arrow)

    return run


def chunk_ranges(lines: DataFrame, key: str, *, section: str | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(key, start_line, end_line) of the chunks of (key, line_no from 0 without gaps, line); a change of ``section`` between neighbours starts a chunk."""
    halo = scope.MAX_CHARS + 1
    if block_lines <= halo:
        raise ValueError(f"a block needs more than {halo} lines")
    key_type = lines.schema[key].dataType
    block = F.floor(F.col("line_no") / block_lines).cast("long")
    also_before = (F.col("line_no") % block_lines < halo) & (block > 0)
    slim = lines.select(
        key, F.col("line_no").cast("long").alias("line_no"), F.length("line").alias("length"), is_table_row(F.col("line")).alias("tabular"),
        (F.col(section) if section else F.lit(0)).alias(_SECTION),
    )
    dealt = slim.withColumn("block", F.explode(F.when(also_before, F.array(block, block - 1)).otherwise(F.array(block))))
    mapped = T.StructType().add(key, key_type).add("block", T.LongType())
    for name in ("pointers", "exits"):
        mapped = mapped.add(name, T.BinaryType())
    maps = cut_lineage(dealt.groupBy(key, "block").applyInArrow(_maps(key, block_lines, halo, to_arrow_schema(mapped)), mapped))
    entered = T.StructType().add(key, key_type).add("block", T.LongType()).add("entry", T.LongType())
    along = maps.select(key, "block", "exits").repartition(key).sortWithinPartitions(key, "block")
    entries = along.mapInArrow(_entered(key, block_lines, to_arrow_schema(entered)), entered)
    out = T.StructType().add(key, key_type).add("start_line", T.LongType()).add("end_line", T.LongType())
    both = maps.select(key, "block", "pointers").join(entries.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")) & (maps["block"] == entries["block"]))
    return both.select(key, maps["block"], "entry", "pointers").mapInArrow(_walked(key, block_lines, to_arrow_schema(out)), out)


def chunk_lines(lines: DataFrame, key: str, *, section: str | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Chunks of a table of lines, as ``chunks.chunk_rows`` makes them of documents: key, chunk_index, item_section, start_line, end_line, text.

    Blank chunks are dropped before numbering. A document's lines, blocks and chunks are spread over tasks; a chunk's own lines are the largest group."""
    ranges = chunk_ranges(lines, key, section=section, block_lines=block_lines)
    each = ranges.select(F.col(key).alias("__key"), "start_line", "end_line", F.explode(F.sequence(F.col("start_line"), F.col("end_line") - 1)).alias("__line"))
    named = lines.select(key, F.col("line_no").cast("long").alias("line_no"), "line", (F.col(section) if section else F.lit(scope.UNSECTIONED)).alias("item_section"))
    placed = named.join(each, F.col(key).eqNullSafe(F.col("__key")) & (F.col("line_no") == F.col("__line")))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    texts = placed.groupBy(key, "start_line", "end_line").agg(F.first("item_section").alias("item_section"), strip(F.array_join(in_order, "\n")).alias("text")).filter("text <> ''")
    numbered = block_scan(texts, [key], ["start_line"], line_block("start_line"), place=Scan("position"))
    return numbered.select(
        key, (F.col("place") - 1).cast("int").alias("chunk_index"), "item_section", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "text",
    )

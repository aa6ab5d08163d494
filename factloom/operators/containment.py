"""Which documents contain a passage verbatim: all passages at once, in one pass over the texts.

The passages of a block of bounded size form one automaton (Aho-Corasick), which reads a text once and reports every passage that occurs in it, however many there are and wherever they
overlap. Nothing but hits is shuffled or joined; more passages than a block holds cost one more pass for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.operators.gates import union_all
from factloom.session import cut_lineage

# Characters of passages that are sent to every executor at a time; a node of the automaton takes about a hundred bytes.
BLOCK_CHARS = 500_000
_BUILT: dict[str, object] = {}


def _automaton(name: str, passages: list[str]):
    """Built once in each Python worker; the one before is given back."""
    import ahocorasick

    if name not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton()
        for number, passage in enumerate(passages):
            made.add_word(passage, number)
        made.make_automaton()
        _BUILT[name] = made
    return _BUILT[name]


def _blocks(passages: DataFrame, passage_id: str) -> Iterator[dict[str, list]]:
    """Different passages and the ids of each, a block at a time."""
    held: dict[str, list] = {}
    size = 0
    for row in passages.select(passage_id, "passage").filter("passage <> ''").toLocalIterator():
        new = 0 if row["passage"] in held else len(row["passage"])
        if held and size + new > BLOCK_CHARS:
            yield held
            held, size, new = {}, 0, len(row["passage"])
        held.setdefault(row["passage"], []).append(row[passage_id])
        size += new
    if held:
        yield held


def passages_in(docs: DataFrame, passages: DataFrame, doc_id: str, passage_id: str) -> DataFrame:
    """(passage_id, doc_id) for docs (doc_id, text) and passages (passage_id, passage); empty and NULL passages are in no document.

    The hits of a block of passages are stored before the next block is read; those of the last block stay lazy."""
    spark = docs.sparkSession
    output = T.StructType().add(passage_id, passages.schema[passage_id].dataType).add(doc_id, docs.schema[doc_id].dataType)
    arrow = to_arrow_schema(output)

    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, block = shared.value
            automaton = _automaton(name, list(block))
            known = pa.array([i for ids in block.values() for i in ids], arrow.field(0).type)
            ends = np.cumsum([0, *map(len, block.values())]).tolist()
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for number in {n for _, n in automaton.iter(text)} if text else ():
                        found += range(ends[number], ends[number + 1])
                        rows += [i] * (ends[number + 1] - ends[number])
                yield pa.RecordBatch.from_arrays([known.take(pa.array(found, pa.int64())), batch.column(doc_id).take(pa.array(rows, pa.int64()))], schema=arrow)

        return run

    parts, shared = [], None
    for block in _blocks(passages, passage_id):
        if shared is not None:
            parts[-1] = cut_lineage(parts[-1])
            shared.unpersist()
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        parts.append(docs.select(doc_id, F.col("text")).mapInArrow(task(shared), output))
    return union_all(parts) if parts else spark.createDataFrame([], output)

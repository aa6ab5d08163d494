"""Incremental jobs: the same operators, run over what is new since the last checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom import scope
from factloom.operators.embedding import Encoder, embed, pending
from factloom.operators.rate_limit import admit
from factloom.operators.scan import keep_first
from factloom.session import cut_lineage

if TYPE_CHECKING:
    from factloom.serving.tools import Corpus


def _run_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def embed_stream(docs: DataFrame, encoder: Encoder, target: str, checkpoint: str, id_col: str = "id") -> StreamingQuery:
    """Encode arriving documents and append their vectors to a parquet folder.

    A replayed batch meets its own vectors in the anti-join, so a document is stored once even if
    an executor or the driver is lost between the write and the commit."""

    def work(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        schema = T.StructType([batch.schema[id_col]]).add("embedding", T.ArrayType(T.DoubleType()))
        first = keep_first(batch, [id_col], [F.col("text")])
        try:
            stored = spark.read.schema(schema).parquet(target)
        except Exception as problem:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            stored = spark.createDataFrame([], schema)
        embed(pending(first, stored, id_col), encoder).select(id_col, "embedding").write.mode("append").parquet(target)

    return _run_available(docs, work, checkpoint)


def load_stream(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Idempotent load of arriving rows into a stored table."""
    from factloom.sources.tables import append_new

    return _run_available(rows, lambda batch, _: append_new(batch.sparkSession, table, batch), checkpoint)


def ask_stream(requests: DataFrame, corpus: Corpus, table: str, checkpoint: str, years=scope.FISCAL_YEARS) -> StreamingQuery:
    """Answer arriving (request_id, question) rows and store one memo per request.

    All requests of a micro-batch are answered together, so the corpus is searched once for all of them. A request that is stored already is neither answered nor
    stored again: a replayed batch, or a request that is sent twice, changes nothing."""
    from factloom.plans.answering import answer
    from factloom.serving.tools import answer_search
    from factloom.sources.tables import append_new, create_table

    def work(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        asked = keep_first(batch.select("request_id", "question"), ["request_id"], [F.col("question")])
        if spark.catalog.tableExists(table):
            asked = asked.join(spark.table(table).select("request_id"), "request_id", "left_anti")
        asked = cut_lineage(asked)
        if asked.isEmpty():
            return
        memos = answer(asked, corpus.chunks, corpus.anchors, search=answer_search(corpus), years=years)
        create_table(spark, table, memos.schema)
        append_new(spark, table, memos)

    return _run_available(requests, work, checkpoint)


def shed_stream(requests: DataFrame, key: str, ts: str, rate: float = scope.ASK_RATE, capacity: float = scope.ASK_BURST) -> DataFrame:
    """Token bucket per caller over a stream. The state is two numbers per caller.

    A caller's rows of one micro-batch are decided together in time order, so bound the
    micro-batch at the source (for files: `maxFilesPerTrigger`)."""
    output = T.StructType([requests.schema[key]]).add("at_us", T.LongType()).add("allowed", T.BooleanType())
    state_type = T.StructType().add("tokens", T.DoubleType()).add("last_us", T.LongType())

    def decide(caller: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values("at_us", kind="stable")
        rows["piece"] = 0
        allowed, _, (_, tokens, last) = admit(rows, (0, tokens, last), rate, capacity)
        state.update((float(tokens), int(last)))
        yield pd.DataFrame({key: caller[0], "at_us": rows["at_us"], "allowed": allowed})

    timed = requests.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"))
    return timed.groupBy(key).applyInPandasWithState(decide, output, state_type, "append", GroupStateTimeout.NoTimeout)

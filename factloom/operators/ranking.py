"""Searches by blocks of queries: each task scores its own rows and keeps k of them per query.

The shuffle carries at most k rows per query and task, however many (query, row) pairs match. Queries
travel as broadcasts of bounded size, one block after another; the searched rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.functions.numeric import rounded
from factloom.operators.gates import union_all
from factloom.operators.scan import per_key_top
from factloom.session import cut_lineage

# Scores are rounded before ranking, so the order of floating-point additions cannot move a hit.
SCORE_DECIMALS = 9
# Document column -> query column with the allowed values (an empty array allows everything).
REQUEST_SCOPE = {"ticker": "tickers", "fiscal_year": "fiscal_years"}


def metadata_filter(df: DataFrame, **allowed) -> DataFrame:
    """Keep rows whose columns take one of the given values; an empty list filters nothing."""
    for column, values in allowed.items():
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


def top_hits(scores: DataFrame, top_k: int, id_col: str) -> DataFrame:
    """query_id, rank, id, score: best score first, then smallest id."""
    decimals = scores.withColumn("score", rounded(F.col("score"), SCORE_DECIMALS))
    ranked = per_key_top(decimals, ["query_id"], [F.desc("score"), F.asc(id_col)], top_k)
    return ranked.select("query_id", "rank", id_col, "score")


def scope_columns(docs: DataFrame, queries: DataFrame) -> dict[str, str]:
    """Per-query filters apply where both sides carry the columns."""
    return {d: q for d, q in REQUEST_SCOPE.items() if d in docs.columns and q in queries.columns}


def allowed(rows: pd.DataFrame, question, scoped: dict[str, str]) -> np.ndarray:
    """Which rows lie in a query's own scope; an empty list allows everything."""
    keep = np.ones(len(rows), dtype=bool)
    for document, wanted in scoped.items():
        values = getattr(question, wanted)
        if values is not None and len(values):
            keep &= rows[document].isin(list(values)).to_numpy()
    return keep


def best(places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties broken by the smaller place in id order."""
    rounded = np.round(scores, SCORE_DECIMALS)
    keep = np.arange(len(rounded))
    if len(rounded) > k:
        keep = np.flatnonzero(rounded >= np.partition(rounded, -k)[-k])
    return keep[np.lexsort((places[keep], -rounded[keep]))[:k]]


def id_places(ids: np.ndarray) -> np.ndarray:
    places = np.empty(len(ids), np.int64)
    places[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return places


def hits_of(questions: pd.DataFrame, ids: np.ndarray, id_col: str, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Candidates as a frame, from (number of the query, positions, scores)."""
    which = np.concatenate([np.full(len(rows), j) for j, rows, _ in found])
    rows = np.concatenate([rows for _, rows, _ in found])
    scores = np.concatenate([scores for _, _, scores in found])
    return pd.DataFrame({"query_id": questions["query_id"].to_numpy()[which], id_col: ids[rows], "score": scores})


def _trim(candidates: pd.DataFrame, k: int, id_col: str) -> pd.DataFrame:
    keyed = candidates.assign(_s=-candidates["score"].round(SCORE_DECIMALS)).sort_values(["query_id", "_s", id_col])
    return keyed.groupby("query_id", sort=False).head(k).drop(columns="_s")


def query_blocks(asked: DataFrame, limit: int, size: Callable[[dict], int]) -> Iterator[pd.DataFrame]:
    """The queries in blocks whose sizes add up to ``limit`` at most; a larger query is a block of its own."""
    held, total = [], 0
    for row in asked.toLocalIterator():
        question = row.asDict()
        n = size(question)
        if held and total + n > limit:
            yield pd.DataFrame(held)
            held, total = [], 0
        held.append(question)
        total += n
    if held:
        yield pd.DataFrame(held)


def search_blocks(rows: DataFrame, asked: DataFrame, top_k: int, id_col: str, *, limit: int, size: Callable[[dict], int],
                  prepare: Callable[[pd.DataFrame], tuple[object, DataFrame]],
                  score: Callable[[pa.RecordBatch, pd.DataFrame, object, int], Iterator[pd.DataFrame]]) -> DataFrame:
    """Top k of ``rows`` per query. ``prepare`` turns a block of queries into what tasks need and the rows they read, ``rows`` or what it made of them; ``score`` yields the candidates of a batch.

    The hits of a block are stored before the next block is read, so the driver holds one block at a time; the last block stays lazy."""
    output = (
        T.StructType()
        .add("query_id", asked.schema["query_id"].dataType)
        .add(id_col, rows.schema[id_col].dataType)
        .add("score", T.DoubleType())
    )
    arrow = to_arrow_schema(output)

    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            questions, prepared = shared.value
            held = None
            for batch in batches:
                if batch.num_rows:
                    for new in score(batch, questions, prepared, top_k):
                        held = new if held is None else _trim(pd.concat([held, new]), top_k, id_col)
            if held is not None:
                yield pa.RecordBatch.from_pandas(held, schema=arrow, preserve_index=False)

        return run

    parts, shared = [], None
    for questions in query_blocks(asked, limit, size):
        if shared is not None:
            parts[-1] = cut_lineage(parts[-1])
            shared.unpersist()
        prepared, read = prepare(questions)
        shared = rows.sparkSession.sparkContext.broadcast((questions, prepared))
        parts.append(top_hits(read.mapInArrow(task(shared), output), top_k, id_col))
    return union_all(parts) if parts else top_hits(rows.sparkSession.createDataFrame([], output), top_k, id_col)

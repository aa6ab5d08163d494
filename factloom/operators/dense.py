"""Exact dense retrieval: cosine similarity, top k per query.

Each task multiplies its own vectors with a block of queries and keeps k candidates per query, so
the shuffle carries k rows per query and task however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from factloom import scope
from factloom.operators.ranking import allowed, best, hits_of, id_places, metadata_filter, scope_columns, search_blocks

# Vector elements of the queries that are sent to every executor at a time.
BLOCK_VALUES = 4_000_000
# Scores (vectors times queries) a task computes at a time.
PRODUCT = 1_000_000


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column; they must have one length and no NULL element."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, flat = pc.unique(pc.list_value_length(column)), column.flatten()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(lengths.to_pylist())[:5]}")
    if flat.null_count:
        raise ValueError("a vector has a NULL element")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def dense_search(corpus: DataFrame, queries: DataFrame, top_k: int = scope.DEFAULT_TOP_K, *, id_col: str = "id",
                 within: dict[str, str] | None = None, **filters) -> DataFrame:
    """corpus (id, embedding), queries (query_id, vector) -> query_id, rank, id, score.

    Rows without a vector are left out; vectors of another dimension than the queries' are an error.
    ``within`` names further corpus columns and the query columns that list their allowed values."""
    scoped = {**scope_columns(corpus, queries), **(within or {})}
    vectors = metadata_filter(corpus, **filters).filter("embedding is not null").select(id_col, *scoped, "embedding")
    asked = queries.filter("vector is not null").select("query_id", *scoped.values(), "vector")

    def prepare(questions: pd.DataFrame) -> tuple[np.ndarray, DataFrame]:
        return _unit(_matrix(pa.array(questions.pop("vector"), pa.list_(pa.float64())))), vectors

    def score(batch: pa.RecordBatch, questions: pd.DataFrame, asked_units: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
        step = max(1, PRODUCT // len(questions))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            rows, units = part.drop_columns(["embedding"]).to_pandas(), _unit(_matrix(part.column("embedding")))
            if units.shape[1] != asked_units.shape[1]:
                raise ValueError(f"vectors have {units.shape[1]} dimensions, queries {asked_units.shape[1]}")
            ids = rows[id_col].to_numpy()
            places, found = id_places(ids), []
            similarity = units @ asked_units.T
            for j, question in enumerate(questions.itertuples(index=False)):
                own = np.flatnonzero(allowed(rows, question, scoped)) if scoped else np.arange(len(ids))
                pick = best(places[own], similarity[own, j], k)
                found.append((j, own[pick], similarity[own[pick], j]))
            yield hits_of(questions, ids, id_col, found)

    return search_blocks(vectors, asked, top_k, id_col, limit=BLOCK_VALUES, size=lambda q: len(q["vector"]), prepare=prepare, score=score)

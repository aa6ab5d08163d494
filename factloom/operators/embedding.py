"""Embedding the corpus: full, incremental, and the completeness gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import words
from factloom.functions.vectors import hashing_encoder
from factloom.operators.gates import violations

Encoder = Callable[[Column], Column]


def hash_encoder(dimension: int) -> Encoder:
    """Offline default: signed feature hashing of words, L2-normalised."""
    encode = hashing_encoder(dimension)
    return lambda text: encode(words(text))


def embed(docs: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    return docs.withColumn("embedding", encoder(F.col(text)))


def pending(docs: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """Documents that have no stored vector; ids only take part in the join's build side."""
    done = vectors.filter("embedding is not null").select(id_col)
    return docs.join(done, id_col, "left_anti")


def embed_pending(docs: DataFrame, vectors: DataFrame, encoder: Encoder, id_col: str = "id", limit: int | None = None) -> DataFrame:
    """Stored vectors plus new ones for what is missing. `limit` bounds one run exactly, smallest
    ids first; the next run continues where this one stopped."""
    todo = pending(docs, vectors, id_col)
    if limit is not None:
        # only ids are ordered and cut; the texts are picked up by a semi-join
        todo = todo.join(todo.select(id_col).orderBy(id_col).limit(limit), id_col, "left_semi")
    fresh = embed(todo, encoder).select(id_col, "embedding")
    kept = vectors.filter("embedding is not null").select(id_col, "embedding")
    return kept.unionByName(fresh)


def completeness_gate(vectors: DataFrame, id_col: str = "id") -> DataFrame:
    missing = vectors.filter("embedding is null")
    return violations(missing, "no embedding", F.col(id_col), F.lit(""))

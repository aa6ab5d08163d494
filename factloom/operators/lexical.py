"""Lexical retrieval: any query term may match, scored per document, top k per query.

Queries arrive as a table, so one job answers all of them. Terms are found in Spark; a task then lists, for each term of a block of queries,
which of its own documents hold it how often, adds up the lists of each query's terms and keeps k documents per query. Pairs of query and document are
neither shuffled nor stored, and nothing is done for pairs that do not match. Rankings that need statistics of all documents store those lists, so that texts are read once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom import scope
from factloom.functions.numeric import runs
from factloom.functions.stemming import lexemes
from factloom.functions.text import words
from factloom.operators.ranking import allowed, best, hits_of, id_places, metadata_filter, scope_columns, search_blocks, top_hits
from factloom.session import shared_folder

ANALYSERS: dict[str, Callable[[Column], Column]] = {"plain": words, "english": lexemes}
BM25_K1, BM25_B = 1.2, 0.75
# Query terms that are sent to every executor at a time, and tokens of documents a task counts at a time.
BLOCK_TERMS, COUNTERS = 50_000, 1_000_000


@dataclass(frozen=True)
class Ranking:
    """Score of a document: sum over terms of idf(documents, those with the term) * weight(count, document length, mean length).

    The weight grows with the count and does not grow with the length."""

    idf: Callable[[int, np.ndarray], np.ndarray]
    weight: Callable[[np.ndarray, np.ndarray, float], np.ndarray]
    needs_statistics: bool


RANKINGS = {
    "cover_density": Ranking(lambda n, df: np.ones(len(df)), lambda tf, length, mean: tf * scope.COVER_WEIGHT, False),
    "bm25": Ranking(
        lambda n, df: np.log(1.0 + (n - df + 0.5) / (df + 0.5)),
        lambda tf, length, mean: tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean)), True,
    ),
}


def query_terms(queries: DataFrame, analyser: str = "plain") -> DataFrame:
    """(query_id, term), distinct, from (query_id, query)."""
    return queries.select(
        "query_id", F.explode(F.array_distinct(ANALYSERS[analyser](F.col("query")))).alias("term")
    )


@dataclass
class Postings:
    """Documents of a run of rows by term: those of term t are docs[start[t] : start[t + 1]]."""

    first: int
    lengths: np.ndarray
    start: np.ndarray
    docs: np.ndarray
    tf: np.ndarray


def _postings(batch: pa.RecordBatch, terms: pa.Array) -> Iterator[Postings]:
    """Runs of at most COUNTERS tokens (one document at least) of a batch, inverted for the given terms."""
    tokens = batch.column("tokens")
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for at, end in runs(lengths, COUNTERS):
        n = end - at
        part = pc.fill_null(pc.index_in(tokens.slice(at, n).flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(part >= 0)
        owner = np.repeat(np.arange(n), lengths[at:end])[known]
        pairs, tf = np.unique(part[known].astype(np.int64) * n + owner, return_counts=True)
        yield Postings(at, lengths[at:end], np.searchsorted(pairs, np.arange(len(terms) + 1) * n), pairs % n, tf)


_NUMBERS = ("lengths", "start", "docs", "tf")


def _packed(values: np.ndarray) -> bytes:
    """Counts in the fewest whole bytes each."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _unpacked(held: bytes, n: int) -> np.ndarray:
    return np.frombuffer(held, f"u{max(1, len(held) // max(n, 1))}").astype(np.int64)


def _held_postings(docs: DataFrame, terms: pa.Array, id_col: str, scoped: list[str]) -> DataFrame:
    """Postings of the given terms, stored: the documents are read once, for their statistics and their scores. A row is a run of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kept = [id_col, *scoped]
    schema = T.StructType().add("present", T.LongType())
    for name in kept:
        schema = schema.add(f"all_{name}", T.ArrayType(docs.schema[name].dataType))
    for name in _NUMBERS:
        schema = schema.add(name, T.BinaryType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _postings(batch, shared.value):
                n = len(part.lengths)
                rows = batch.slice(part.first, n)
                columns = [pa.array([n - rows.column("tokens").null_count])]
                columns += [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([rows.column(c)])) for c in kept]
                columns += [pa.array([_packed(getattr(part, name))], pa.binary()) for name in _NUMBERS]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    path = f"{shared_folder(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    docs.mapInArrow(run, schema).write.parquet(path)
    shared.unpersist()
    return docs.sparkSession.read.schema(schema).parquet(path)


def _runs_held(batch: pa.RecordBatch, n_terms: int) -> Iterator[tuple[pd.DataFrame, Postings]]:
    names = [c for c in batch.schema.names if c.startswith("all_")]
    for i in range(batch.num_rows):
        rows = pd.DataFrame({c.removeprefix("all_"): batch.column(c)[i].values.to_pandas() for c in names})
        held = {c: batch.column(c)[i].as_py() for c in _NUMBERS}
        start = _unpacked(held["start"], n_terms + 1)
        yield rows, Postings(0, _unpacked(held["lengths"], len(rows)), start, _unpacked(held["docs"], start[-1]), _unpacked(held["tf"], start[-1]))


def _collection(held: DataFrame, n_terms: int) -> tuple[int, np.ndarray, float]:
    """Number of documents, of those with each term, and the mean length: one row per term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, present, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            present += pc.sum(batch.column("present")).as_py() or 0
            for start, lengths, n in zip(*(batch.column(c).to_pylist() for c in ("start", "lengths", "n"))):
                holding += np.diff(_unpacked(start, n_terms + 1))
                total += int(_unpacked(lengths, n).sum())
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, [-1, -2]), pa.int64()), pa.array(np.append(holding[some], [present, total]), pa.int64())], names=["term", "n"]
        )

    ids = next(c for c in held.columns if c.startswith("all_"))
    slim = held.select("present", "start", "lengths", F.size(ids).alias("n"))
    sums = dict(slim.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    n_docs = sums.get(-1) or 0
    return n_docs, np.array([sums.get(i, 0) for i in range(n_terms)], np.float64), (sums.get(-2) or 0) / n_docs if n_docs else 1.0


def _search(docs: DataFrame, queries: DataFrame, top_k: int, id_col: str, analyser: str, ranking: Ranking) -> DataFrame:
    scoped = scope_columns(docs, queries)
    found = docs.select(id_col, *scoped, ANALYSERS[analyser](F.col("text")).alias("tokens"))
    asked = queries.select("query_id", *scoped.values(), F.array_distinct(ANALYSERS[analyser](F.col("query"))).alias("terms")).filter("size(terms) > 0")

    def prepare(questions: pd.DataFrame):
        asked_terms = [list(t) for t in questions.pop("terms")]
        terms = pa.array(sorted({t for row in asked_terms for t in row}), pa.string())
        number = {t: i for i, t in enumerate(terms.to_pylist())}
        own = [np.array([number[t] for t in row]) for row in asked_terms]
        if not ranking.needs_statistics:
            return (terms, own, ranking.idf(0, np.zeros(len(terms))), 1.0), found
        held = _held_postings(found, terms, id_col, list(scoped))
        n_docs, df, mean = _collection(held, len(terms))
        return (terms, own, ranking.idf(n_docs, df), mean), held

    def parts(batch: pa.RecordBatch, terms: pa.Array) -> Iterator[tuple[pd.DataFrame, Postings]]:
        if ranking.needs_statistics:
            yield from _runs_held(batch, len(terms))
        else:
            for part in _postings(batch, terms):
                yield batch.slice(part.first, len(part.lengths)).drop_columns(["tokens"]).to_pandas(), part

    def score(batch: pa.RecordBatch, questions: pd.DataFrame, prepared, k: int) -> Iterator[pd.DataFrame]:
        terms, own, idf, mean = prepared
        for rows, part in parts(batch, terms):
            n, ids = len(part.lengths), rows[id_col].to_numpy()
            weights = ranking.weight(part.tf, part.lengths[part.docs], mean) * np.repeat(idf, np.diff(part.start))
            places, hits = id_places(ids), []
            for j, question in enumerate(questions.itertuples(index=False)):
                sizes = part.start[own[j] + 1] - part.start[own[j]]
                if not sizes.any():
                    continue
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) + np.repeat(part.start[own[j]] - (ends - sizes), sizes)
                scores = np.bincount(part.docs[at], weights[at], n)
                matched = scores > 0
                if scoped:
                    matched &= allowed(rows, question, scoped)
                matched = np.flatnonzero(matched)
                pick = best(places[matched], scores[matched], k)
                hits.append((j, matched[pick], scores[matched[pick]]))
            if hits:
                yield hits_of(questions, ids, id_col, hits)

    return search_blocks(found, asked, top_k, id_col, limit=BLOCK_TERMS, size=lambda q: len(q["terms"]), prepare=prepare, score=score)


def cover_density(docs: DataFrame, queries: DataFrame, top_k: int, id_col: str = "id", analyser: str = "plain") -> DataFrame:
    """Rank by 0.1 for every matching position."""
    return _search(docs, queries, top_k, id_col, analyser, RANKINGS["cover_density"])


def bm25(docs: DataFrame, queries: DataFrame, top_k: int, id_col: str = "id", analyser: str = "plain") -> DataFrame:
    """Rank by BM25 over all given documents; a request's own scope does not change the statistics."""
    return _search(docs, queries, top_k, id_col, analyser, RANKINGS["bm25"])


SCORERS = {"cover_density": cover_density, "bm25": bm25}


def lexical_search(docs: DataFrame, queries: DataFrame, top_k: int = scope.DEFAULT_TOP_K, *, id_col: str = "id",
                   scorer: str = "cover_density", analyser: str = "plain", **filters) -> DataFrame:
    return SCORERS[scorer](metadata_filter(docs, **filters), queries, top_k, id_col, analyser)


# --- stored index -------------------------------------------------------------------------------

def postings(docs: DataFrame, id_col: str = "id", analyser: str = "plain") -> DataFrame:
    """(id, term, tf), one row for each distinct term of a document."""
    tokens = docs.select(id_col, F.explode(ANALYSERS[analyser](F.col("text"))).alias("term"))
    return tokens.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def write_postings(docs: DataFrame, table: str, buckets: int, id_col: str = "id", analyser: str = "plain") -> None:
    """Document-partitioned inverted index: bucketed by document, sorted by term in each bucket.

    A search then scores every document inside its own bucket, without a shuffle before the
    top-k, and the term order lets the scan skip row groups."""
    index = postings(docs, id_col, analyser)
    writer = index.repartition(buckets, id_col).write.mode("overwrite").format("parquet")
    writer.bucketBy(buckets, id_col).sortBy("term").saveAsTable(table)


def search_postings(spark: SparkSession, table: str, queries: DataFrame, top_k: int, id_col: str = "id", analyser: str = "plain") -> DataFrame:
    """Cover-density search over the stored index."""
    matched = spark.table(table).select(id_col, "term", "tf").join(query_terms(queries, analyser), "term")
    scores = matched.groupBy("query_id", id_col).agg((F.sum("tf") * F.lit(scope.COVER_WEIGHT)).alias("score"))
    return top_hits(scores, top_k, id_col)

"""Approximate dense retrieval over product-quantised residuals, with exact re-ranking.

Cells and codebooks are fitted on a sample of at most ``sample`` vectors, those with the smallest hash of their id, whatever the table's size; every vector is indexed. A vector belongs to the cell of
the nearest centre; what it differs by from the centre is cut into sub-vectors, each replaced by the number of the nearest of the cell's own ``CODES`` codewords. A search reads ids and codes
of the probed cells only: the score of a code is that of the centre and codewords it stands for. The best of these estimates, ``shortlist`` times k, are scored exactly on
their stored vectors.

Cells are written in blocks of bounded rows, so a cell that holds a large share of the vectors is encoded and read by many tasks. What is broadcast, queries and the codebooks of the cells
they probe, is bounded: queries are taken in blocks of ``BLOCK_BYTES`` of both. 256 codewords for four dimensions, two bits a dimension, keep the neighbours of vectors without any structure in a shortlist of ten times k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom import scope
from factloom.functions.vectors import l2_normalise
from factloom.operators.dense import _matrix, _unit, dense_search
from factloom.operators.ranking import best, hits_of, id_places, search_blocks, top_hits
from factloom.session import cut_lineage

CODES, SUB_DIMENSION, BLOCK_ROWS, BLOCK_BYTES = 256, 4, 65_536, 64 << 20
ROUNDS = 12
# Distances to codewords, or estimated scores, that a task computes at a time.
PRODUCT = 4_000_000


def fitted_codewords(residuals: np.ndarray, seed: int = 1) -> np.ndarray:
    """(sub-vectors, CODES, SUB_DIMENSION): k-means of each sub-vector of the residuals; the last one is filled up with zeros."""
    n, d = residuals.shape
    parts = -(-d // SUB_DIMENSION)
    padded = np.zeros((n, parts * SUB_DIMENSION))
    padded[:, :d] = residuals
    split = padded.reshape(n, parts, SUB_DIMENSION).transpose(1, 0, 2)
    pick = np.random.default_rng(seed).choice(n, CODES, replace=n < CODES)
    words = split[:, pick].copy()
    for _ in range(ROUNDS):
        for own, part, code in zip(words, split, nearest(split, words)):
            count = np.bincount(code, minlength=CODES)
            total = np.stack([np.bincount(code, column, CODES) for column in part.T], 1)
            own[count > 0] = total[count > 0] / count[count > 0, None]
    return words


def nearest(split: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(sub-vectors, vectors) number of the nearest codeword."""
    lengths, step = (words**2).sum(2)[:, None, :], max(1, PRODUCT // (words.shape[0] * words.shape[1]))
    return np.concatenate([(lengths - 2 * split[:, at : at + step] @ words.transpose(0, 2, 1)).argmin(2) for at in range(0, split.shape[1], step)], 1)


def encoded(units: np.ndarray, centre: np.ndarray, words: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(units), words.shape[0] * SUB_DIMENSION))
    padded[:, : units.shape[1]] = units - centre
    return nearest(padded.reshape(len(units), words.shape[0], SUB_DIMENSION).transpose(1, 0, 2), words).T.astype(np.uint8)


def nearest_centre(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * units @ centres.T).argmin(1)


def _cell_of(centres: np.ndarray, embedding: str = "embedding"):
    shared = SparkSession.getActiveSession().sparkContext.broadcast(centres)  # one row a cell

    @F.arrow_udf("int")
    def cell(vectors: pa.Array) -> pa.Array:
        return pa.array(nearest_centre(_unit(_matrix(vectors)), shared.value).astype(np.int32))

    return cell(F.col(embedding))


def write_quantised_index(vectors: DataFrame, path: str, cells: int, *, id_col: str = "id", sample: int = 100_000, seed: int = 1) -> None:
    """(id, embedding and further columns) to cells, codes and vectors under ``path``; rows without a vector are left out."""
    spark, some = vectors.sparkSession, vectors.filter("embedding is not null")
    chosen = cut_lineage(some.select(id_col, "embedding").orderBy(F.xxhash64(id_col), id_col).limit(sample))
    units = chosen.withColumn("_unit", array_to_vector(l2_normalise(F.col("embedding").cast("array<double>"))))
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=15, featuresCol="_unit").fit(units).clusterCenters()) if not chosen.isEmpty() else np.zeros((1, 1))
    book = T.StructType().add("cell", T.IntegerType()).add("centre", T.ArrayType(T.DoubleType())).add("words", T.ArrayType(T.DoubleType()))
    arrow = to_arrow_schema(book)

    def fit(group: pa.Table) -> pa.Table:
        number, own = group.column("cell")[0].as_py(), _unit(_matrix(group.column("embedding")))
        words = fitted_codewords(own - centres[number], seed)
        return pa.table([pa.array([number]), pa.array([centres[number].tolist()]), pa.array([words.ravel().tolist()])], schema=arrow)

    # A cell's part of the sample is bounded by the sample.
    chosen.withColumn("cell", _cell_of(centres)).groupBy("cell").applyInArrow(fit, book).write.mode("overwrite").parquet(f"{path}/cells")
    books = spark.read.schema(book).parquet(f"{path}/cells")
    known = np.array([r["cell"] for r in books.select("cell").collect()], int)  # cells without a sampled vector hold none
    placed = some.withColumn("cell", F.element_at(F.array(*[F.lit(int(c)) for c in sorted(known)]) if len(known) else F.array(F.lit(0)), _cell_of(centres[np.sort(known)] if len(known) else centres) + 1))
    placed = cut_lineage(placed)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))  # one row a cell
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")).drop("blocks")
    per_block = books.join(F.broadcast(sizes), "cell").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    out = T.StructType([f for f in dealt.schema if f.name != "block"]).add("codes", T.BinaryType())
    out_arrow = to_arrow_schema(out)

    def encode(rows: pa.Table, books_: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out_arrow.empty_table()
        centre, words = (np.array(books_.column(c)[0].as_py()) for c in ("centre", "words"))
        codes = encoded(_unit(_matrix(rows.column("embedding"))), centre, words.reshape(-1, CODES, SUB_DIMENSION))
        return rows.drop_columns(["block"]).append_column("codes", pa.array([c.tobytes() for c in codes], pa.binary())).select(out.names).cast(out_arrow)

    coded = dealt.groupBy("cell", "block").cogroup(per_block.groupBy("cell", "block")).applyInArrow(encode, out)
    coded.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


def search_quantised_index(spark: SparkSession, path: str, queries: DataFrame, top_k: int = scope.DEFAULT_TOP_K, *, probes: int = 8, shortlist: int = 10, id_col: str = "id") -> DataFrame:
    """query_id, rank, id, score (exact cosine) of the best found for (query_id, vector)."""
    if probes < 1 or shortlist < 1:
        raise ValueError("probes and shortlist must be at least 1")
    books = spark.read.parquet(f"{path}/cells")
    stored = spark.read.parquet(f"{path}/vectors")
    asked = queries.filter("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    near = dense_search(books.select(F.col("cell").alias("id"), F.col("centre").alias("embedding")), asked, probes).groupBy("query_id").agg(F.collect_list("id").alias("cells"))
    asked = cut_lineage(asked.join(near, "query_id"))
    # All codebooks where they fill at most half a block; else a query costs its vector and the codebooks of its cells.
    first = books.select(F.size("words").alias("n")).first()
    all_books = books.count() * first["n"] * 8 if first else 0
    shared_books = all_books <= BLOCK_BYTES // 2
    cost = lambda q: len(q["vector"]) * 8 * (1 if shared_books else 1 + len(q["cells"]) * (CODES + 1))
    limit = BLOCK_BYTES - all_books if shared_books else BLOCK_BYTES

    def prepare(questions: pd.DataFrame):
        units = _unit(np.array(questions["vector"].tolist(), float))
        probed = sorted({c for cells in questions["cells"] for c in cells})
        rows = books.filter(F.col("cell").isin(probed)).collect()  # within BLOCK_BYTES
        book = {r["cell"]: (np.array(r["centre"]), np.array(r["words"]).reshape(-1, CODES, SUB_DIMENSION)) for r in rows}
        wanted = {c: np.array([i for i, cells in enumerate(questions["cells"]) if c in cells]) for c in probed}
        return (units, book, wanted), coded

    def score(batch: pa.RecordBatch, questions: pd.DataFrame, prepared, k: int) -> Iterator[pd.DataFrame]:
        units, book, wanted = prepared
        cells, ids = batch.column("cell").to_numpy(), batch.column(id_col).to_pandas().to_numpy()
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        places = id_places(ids)
        for cell in np.unique(cells):
            if cell not in wanted:
                continue
            rows, (centre, words) = np.flatnonzero(cells == cell), book[cell]
            # What the codes stand for; equal codes give equal rows, and so equal estimates.
            stand_in = words[np.arange(codes.shape[1]), codes[rows]].reshape(len(rows), -1)[:, : units.shape[1]] + centre
            step = max(1, PRODUCT // len(rows))
            for at in range(0, len(wanted[cell]), step):
                some = wanted[cell][at : at + step]
                estimates, found = units[some] @ stand_in.T, []
                for i, estimate in zip(some, estimates):
                    pick = best(places[rows], estimate, k)
                    found.append((i, rows[pick], estimate[pick]))
                yield hits_of(questions, ids, id_col, found)

    probed = sorted(r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect())  # bounded by the cells
    coded = stored.filter(F.col("cell").isin(probed)).select("cell", id_col, "codes")
    found = cut_lineage(search_blocks(coded, asked, top_k * shortlist, id_col, limit=limit, size=cost, prepare=prepare, score=score).select("query_id", id_col))

    @F.arrow_udf("double")
    def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array((_unit(_matrix(left)) * _unit(_matrix(right))).sum(1))

    texts = stored.filter(F.col("cell").isin(probed)).select(id_col, "embedding")
    pairs = found.join(texts, id_col).join(asked.select("query_id", "vector"), "query_id")
    return top_hits(pairs.select("query_id", id_col, cosine("embedding", "vector").alias("score")), top_k, id_col)

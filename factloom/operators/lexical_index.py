"""Stored inverted index with block maxima: a search reads postings of its terms only, and decodes few of those.

Documents are indexed in shards, runs of rows of one task with at most ``SHARD_TOKENS`` tokens, so the index is built without a shuffle and can be appended to. Inside a shard documents
are numbered and cut into parts of ``PART``. A row of the index is a posting block: the documents of one part that hold one term, with their counts, and
the block's largest count and smallest document length. One more row for each part keeps the ids, the lengths and the columns that requests may be scoped by. No text is stored.

A search goes shard by shard. The largest score a document of a part can have for a query is the sum over the query's terms of the score at (largest count, smallest length), which
bounds both rankings whatever the collection's statistics are by then. Parts are scored in order of that bound, a growing number at a time, until no part left can reach the k-th score found:
the blocks of those are never decoded. The table is bucketed by shard, so postings are not shuffled; k rows for each query and shard are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom import scope
from factloom.operators.gates import union_all
from factloom.operators.lexical import ANALYSERS, RANKINGS
from factloom.operators.ranking import REQUEST_SCOPE, allowed, best, query_blocks, top_hits
from factloom.session import cut_lineage

PART, SHARD_TOKENS = 512, 4_000_000
# Terms of the queries that are searched in one pass: they stand in the scan's filter.
BLOCK_TERMS = 5_000
# Scores are compared with bounds that were added up in another order.
SLACK = 1e-8


@dataclass(frozen=True)
class LexicalIndex:
    """A handle: where the index lies and how its texts were read."""

    table: str
    id_col: str = "id"
    analyser: str = "plain"
    part_docs: int = PART


def _schema(docs: DataFrame, id_col: str, kept: list[str]) -> T.StructType:
    out = T.StructType().add("shard", T.StringType()).add("part", T.IntegerType()).add("term", T.StringType())
    for name in ("n", "max_tf", "min_length"):
        out = out.add(name, T.IntegerType())
    out = out.add("docs", T.BinaryType()).add("tfs", T.BinaryType()).add("total_length", T.LongType()).add("lengths", T.BinaryType())
    for name in (id_col, *kept):
        out = out.add(f"all_{name}", T.ArrayType(docs.schema[name].dataType))
    return out


def _binary(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """One binary value for each run of ``values`` that begins at a head."""
    offsets = (np.append(heads, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _runs(column: pa.Array, heads: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(heads, len(column)), pa.int32()), column)


def _inverted(rows: pa.Table, name: str, arrow: pa.Schema, part_docs: int = PART) -> Iterator[pa.RecordBatch]:
    """Posting blocks and part rows of one shard."""
    rows = rows.combine_chunks()
    tokens = rows.column("tokens").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.string()))
    n = rows.num_rows
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int32)
    coded = tokens.flatten().dictionary_encode()
    pairs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
    pairs, tf = np.unique(pairs, return_counts=True)
    code, doc = pairs // max(n, 1), (pairs % max(n, 1)).astype(np.int64)
    part = doc // part_docs

    def batch(count: int, **columns) -> pa.RecordBatch:
        full = [columns.get(f.name, pa.nulls(count, f.type)) for f in arrow]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(full, arrow)], schema=arrow)

    starts = np.arange(0, n, part_docs)
    members = {c: _runs(rows.column(c).combine_chunks(), starts) for c in rows.column_names if c != "tokens"}
    yield batch(
        len(starts), shard=pa.array([name] * len(starts)), part=pa.array(np.arange(len(starts))), n=pa.array(np.diff(np.append(starts, n))),
        total_length=pa.array(np.add.reduceat(lengths.astype(np.int64), starts)), lengths=_binary(lengths, starts), **{f"all_{c}": v for c, v in members.items()},
    )
    if len(pairs):
        heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])))
        yield batch(
            len(heads), shard=pa.array([name] * len(heads)), part=pa.array(part[heads]), term=coded.dictionary.take(pa.array(code[heads])), n=pa.array(np.diff(np.append(heads, len(doc)))),
            max_tf=pa.array(np.maximum.reduceat(tf, heads)), min_length=pa.array(np.minimum.reduceat(lengths[doc], heads)),
            docs=_binary((doc % part_docs).astype(np.uint16), heads), tfs=_binary(tf.astype(np.int32), heads),
        )


def write_index(docs: DataFrame, table: str, buckets: int, *, id_col: str = "id", analyser: str = "plain", path: str | None = None, append: bool = False,
                part_docs: int = PART, shard_tokens: int = SHARD_TOKENS) -> LexicalIndex:
    """Index ``docs`` (id, text and, for scoped requests, ticker and fiscal_year) into a bucketed table; texts that are NULL are left out.

    A part has at most 65,536 documents. Ids must be new where the index is appended to. With ``path`` the files lie there and ``open_index`` finds them in a later session."""
    kept = [c for c in REQUEST_SCOPE if c in docs.columns]
    schema = _schema(docs, id_col, kept)
    arrow, build = to_arrow_schema(schema), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, task = [], 0, 0, TaskContext.get().partitionId()

        def name() -> str:
            return hashlib.md5(f"{build}/{task}/{number}".encode()).hexdigest()

        for batch in batches:
            total = np.append(0, np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(total, total[at] + shard_tokens - size, side="right")) - 1)
                held.append(batch.slice(at, end - at))
                size += int(total[end] - total[at])
                if end < batch.num_rows or size >= shard_tokens:
                    yield from _inverted(pa.Table.from_batches(held), name(), arrow, part_docs)
                    held, size, number = [], 0, number + 1
                at = end
        if held:
            yield from _inverted(pa.Table.from_batches(held), name(), arrow, part_docs)

    tokens = docs.filter("text is not null").select(id_col, *kept, ANALYSERS[analyser](F.col("text")).alias("tokens"))
    writer = tokens.mapInArrow(run, schema).write.format("parquet").mode("append" if append else "overwrite")
    if path:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, "shard").sortBy("term").saveAsTable(table)
    return LexicalIndex(table, id_col, analyser, part_docs)


def open_index(spark: SparkSession, path: str, buckets: int, *, id_col: str = "id", analyser: str = "plain", part_docs: int = PART) -> LexicalIndex:
    """The index written below ``path`` with that many buckets, under a name of its own in this session."""
    table = f"lexical_index_{hashlib.md5(path.encode()).hexdigest()}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (shard) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{path}'")
    return LexicalIndex(table, id_col, analyser, part_docs)


@dataclass
class Asked:
    """What tasks need of a block of queries."""

    questions: pd.DataFrame
    terms: pa.Array
    own: list[np.ndarray]
    scorer: str
    idf: np.ndarray
    mean: float
    scoped: dict[str, str]
    k: int


def _span_index(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def shard_hits(rows: pa.Table, asked: Asked, index: LexicalIndex) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, int, int]:
    """Best documents of a shard per query (number of the query, positions, scores), the shard's ids, and how many posting blocks were decoded and skipped."""
    size = index.part_docs
    weight, is_part = RANKINGS[asked.scorer].weight, pc.is_null(rows.column("term"))
    members = rows.filter(is_part).sort_by("part").combine_chunks()
    blocks = rows.filter(pc.invert(is_part)).combine_chunks()
    ids = pc.list_flatten(members.column(f"all_{index.id_col}")).to_numpy()
    lengths = np.frombuffer(b"".join(members.column("lengths").to_pylist()), np.int32)
    tags = pd.DataFrame({c: pc.list_flatten(members.column(f"all_{c}")).to_pandas() for c in asked.scoped})
    places = np.empty(len(ids), np.int64)
    places[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    term = pc.index_in(blocks.column("term"), value_set=asked.terms).to_numpy().astype(np.int64)
    order = np.argsort(term, kind="stable")
    term = term[order]
    n, part, max_tf, min_length = (blocks.column(c).to_numpy()[order].astype(np.int64) for c in ("n", "part", "max_tf", "min_length"))
    data = blocks.select(["docs", "tfs"]).take(pa.array(order))
    offsets, counts = (np.frombuffer(b"".join(data.column(c).to_pylist()), t) for c, t in (("docs", np.uint16), ("tfs", np.int32)))
    starts = np.cumsum(n) - n
    of_term = np.searchsorted(term, np.arange(len(asked.terms) + 1))
    bounds = asked.idf[term] * weight(max_tf, min_length, asked.mean)
    hits, decoded, skipped = [], 0, 0
    for j, question in enumerate(asked.questions.itertuples(index=False)):
        mine = _span_index(of_term[asked.own[j]], of_term[asked.own[j] + 1] - of_term[asked.own[j]])
        if not len(mine):
            continue
        bound = np.bincount(part[mine], bounds[mine], members.num_rows)
        keep = allowed(tags, question, asked.scoped) if asked.scoped else None
        queue = np.flatnonzero(bound > 0)
        queue = queue[np.argsort(-bound[queue], kind="stable")]
        found, scores, least, step = np.zeros(0, np.int64), np.zeros(0), -np.inf, 1 + asked.k // size
        while len(queue):
            now = queue[:step]
            now = now[bound[now] >= least - SLACK]
            if not len(now):
                break
            queue, step = queue[len(now) :], step * 2
            slot = np.full(members.num_rows, -1)
            slot[now] = np.arange(len(now))
            chosen = mine[slot[part[mine]] >= 0]
            decoded += len(chosen)
            at = _span_index(starts[chosen], n[chosen])
            which = np.repeat(chosen, n[chosen])
            docs = part[which] * size + offsets[at]
            weights = asked.idf[term[which]] * weight(counts[at].astype(np.int64), lengths[docs], asked.mean)
            total = np.bincount(slot[part[which]] * size + offsets[at], weights, len(now) * size)
            local = np.flatnonzero(total > 0)
            new = now[local // size] * size + local % size
            new_scores = total[local]
            if keep is not None:
                new, new_scores = new[keep[new]], new_scores[keep[new]]
            found, scores = np.append(found, new), np.append(scores, new_scores)
            pick = best(places[found], scores, asked.k)
            found, scores = found[pick], scores[pick]
            if len(found) == asked.k:
                least = scores.min()
        skipped += int(np.isin(part[mine], queue).sum()) if len(queue) else 0
        hits.append((j, found, scores))
    return hits, ids, decoded, skipped


def search_index(spark: SparkSession, index: LexicalIndex, queries: DataFrame, top_k: int = scope.DEFAULT_TOP_K, *, scorer: str = "cover_density", counters=None) -> DataFrame:
    """query_id, rank, id, score: what ``lexical_search`` finds in the indexed documents, ranked over all of them.

    ``counters`` may be two accumulators that count posting blocks decoded and skipped."""
    ranking, rows = RANKINGS[scorer], spark.table(index.table)
    scoped = {d: q for d, q in REQUEST_SCOPE.items() if f"all_{d}" in rows.columns and q in queries.columns}
    asked = queries.select("query_id", *scoped.values(), F.array_distinct(ANALYSERS[index.analyser](F.col("query"))).alias("terms")).filter("size(terms) > 0")
    id_type = rows.schema[f"all_{index.id_col}"].dataType.elementType
    output = T.StructType().add("query_id", queries.schema["query_id"].dataType).add(index.id_col, id_type).add("score", T.DoubleType())
    arrow, parts, shared = to_arrow_schema(output), [], None

    def task(broadcast):
        def run(table: pa.Table) -> pa.Table:
            hits, ids, decoded, skipped = shard_hits(table, broadcast.value, index)
            if counters:
                counters[0].add(decoded)
                counters[1].add(skipped)
            which = np.concatenate([np.full(len(f), j) for j, f, _ in hits]) if hits else np.zeros(0, np.int64)
            frame = pd.DataFrame({
                "query_id": broadcast.value.questions["query_id"].to_numpy()[which], index.id_col: ids[np.concatenate([f for _, f, _ in hits])] if hits else ids[:0],
                "score": np.concatenate([s for *_, s in hits]) if hits else np.zeros(0),
            })
            return pa.Table.from_pandas(frame, schema=arrow, preserve_index=False)

        return run

    for questions in query_blocks(asked, BLOCK_TERMS, lambda q: len(q["terms"])):
        if shared is not None:
            parts[-1] = cut_lineage(parts[-1])
            shared.unpersist()
        asked_terms = [list(t) for t in questions.pop("terms")]
        terms = sorted({t for row in asked_terms for t in row})
        number = {t: i for i, t in enumerate(terms)}
        matching = rows.filter(F.col("term").isNull() | F.col("term").isin(terms))
        # One row a term (at most BLOCK_TERMS, or one query's) and one for the collection.
        sums = {r["term"]: (r["n"], r["total"]) for r in matching.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total_length").alias("total")).collect()}
        n_docs, total = sums.get(None, (0, 0))
        df = np.array([sums.get(t, (0, 0))[0] for t in terms], np.float64)
        own = [np.array([number[t] for t in row]) for row in asked_terms]
        shared = spark.sparkContext.broadcast(
            Asked(questions, pa.array(terms, pa.string()), own, scorer, ranking.idf(n_docs, df), total / n_docs if n_docs else 1.0, scoped, top_k)
        )
        parts.append(top_hits(matching.groupBy("shard").applyInArrow(task(shared), output), top_k, index.id_col))
    return union_all(parts) if parts else top_hits(spark.createDataFrame([], output), top_k, index.id_col)

"""Target-distribution importance resampling: documents that look like the target corpus are drawn first.

Features are runs of 1 to ``max_words`` words; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. CRC-32 is linear over XOR but for a constant that depends on
the length alone, so it is computed for all features of a slice of texts at once: a table holds what each byte contributes at each distance from the end, the contributions
of a feature's span are joined with ``bitwise_xor.reduceat``, and the constant of the length is added. Spans longer than the table are cut into blocks from their end; neighbouring
blocks are folded two by two, the left one moved on by the table's length, twice that, and so on.

Counting: a task adds up its texts in one vector of ``buckets`` numbers and sends what is not zero, so neither a hot word nor a long text makes a hot key. The summed counts
of both corpora (two vectors of ``buckets``, the only things that pass the driver or are broadcast) give the gain of each bucket in thousandths; a document's weight is the floored mean gain
of its features. Weight plus Gumbel noise from a hash of the id orders the documents: drawing the highest is sampling without replacement in proportion to exp(weight / 1000).

Ranking: the slim rows are dealt by ranges of (score, id, row number), sorted in place and numbered by partition; one count per partition turns these into ranks. No task holds more than its range.

Edge cases: null and empty texts have no features, weight 0, and are not drawn (too few words); a null id draws as the text ``null`` and comes after the others of its score;
rows that repeat an id are documents of their own that share the noise (equal scores go by row number); an empty target or empty documents give gains from the smoothing alone;
an empty table gives an empty result. ``resample`` passes extra columns through; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import ALNUM, LOWER, as_bytes, numbered, partitions, slices, stored, tidy, word_spans

BUCKETS, MAX_WORDS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, bits reversed
REACH = 32  # distances from the end that the table knows
ROW = "_row"
RESULTS = ("n_features", "weight", "score", "rank")


# --- CRC-32 by position ----------------------------------------------------------------------
def one_zero_byte(state: np.ndarray) -> np.ndarray:
    """CRC states after one more zero byte."""
    for _ in range(8):
        state = (state >> np.uint32(1)) ^ np.where(state & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return state


@lru_cache(maxsize=1)
def position_table() -> np.ndarray:
    """What byte b adds at distance d from the end of a message, at d * 256 + b."""
    rows = [one_zero_byte(np.arange(256, dtype=np.uint32))]
    while len(rows) < REACH:
        rows.append(one_zero_byte(rows[-1]))
    return np.concatenate(rows)


def applied(shift: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A linear map of states, given by its values for the 256 values of each of the four bytes."""
    return shift[0][state & 255] ^ shift[1][(state >> 8) & 255] ^ shift[2][(state >> 16) & 255] ^ shift[3][state >> 24]


@lru_cache(maxsize=64)
def block_shift(level: int) -> np.ndarray:
    """Moves a state over REACH * 2**level zero bytes."""
    states = (np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    if level == 0:
        for _ in range(REACH):
            states = one_zero_byte(states)
        return states
    half = block_shift(level - 1)
    return applied(half, applied(half, states))


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of that many zero bytes: what the length alone adds."""
    distinct, inverse = np.unique(lengths, return_inverse=True)
    out = np.full(len(distinct), 0xFFFFFFFF, np.uint32)
    blocks, rest = distinct // REACH, distinct % REACH
    for step in range(REACH):
        more = rest > step
        if more.any():
            out[more] = one_zero_byte(out[more])
    level = 0
    while (blocks >> level).any():
        odd = ((blocks >> level) & 1).astype(bool)
        out[odd] = applied(block_shift(level), out[odd])
        level += 1
    return out[inverse] ^ np.uint32(0xFFFFFFFF)


def crc32_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte spans [start, end); no span is empty."""
    if not len(start):
        return np.zeros(0, np.uint32)
    blocks = (end - start + REACH - 1) // REACH
    if blocks.max() == 1:
        owner, last, first = np.arange(len(start)), end, start
        left = np.zeros(len(start), np.int64)
    else:
        owner = np.repeat(np.arange(len(start)), blocks)
        heads = np.cumsum(blocks) - blocks
        left = blocks[owner] - 1 - (np.arange(len(owner)) - heads[owner])  # blocks to the right in the span
        last = end[owner] - left * REACH
        first = np.maximum(start[owner], last - REACH)
    sizes = last - first
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) - np.repeat(ends - sizes - first, sizes)
    distance = np.repeat(last - 1, sizes) - at
    states = np.bitwise_xor.reduceat(position_table()[(distance << 8) | raw[at]], ends - sizes)
    level = 0
    while left.any():
        odd = (left & 1).astype(bool)
        states[odd] = applied(block_shift(level), states[odd])
        left >>= 1
        new = np.append(True, (owner[1:] != owner[:-1]) | (left[1:] != left[:-1]))
        at = np.flatnonzero(new)
        states, owner, left = np.bitwise_xor.reduceat(states, at), owner[at], left[at]
        level += 1
    return states ^ length_constants(end - start)


# --- features --------------------------------------------------------------------------------
def feature_buckets(texts: pa.Array, max_words: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: first and end row, words of each, text (from the first row) and bucket of each feature."""
    raw, offs = as_bytes(texts)
    for a, b, part, at in slices(raw, offs):
        part = LOWER[part]
        starts, ends, first = word_spans(part, at, ALNUM)
        words = np.diff(first)
        owner = np.repeat(np.arange(b - a), words)
        if max_words > 1:  # one blank between words, so that a run is a span
            sizes = ends - starts + 1
            new_end = np.cumsum(sizes)
            index = np.arange(new_end[-1] if len(new_end) else 0) + np.repeat(starts - (new_end - sizes), sizes)
            spaced = np.append(part, np.uint8(0x20))[index]
            spaced[new_end - 1] = 0x20
            part, starts, ends = spaced, new_end - sizes, new_end - 1
        texts_of, found = [], []
        for k in range(1, max_words + 1):
            n = len(starts) - k + 1
            if n <= 0:
                break
            whole = owner[:n] == owner[k - 1 :]
            found.append(crc32_spans(part, starts[:n][whole], ends[k - 1 :][whole]) % np.uint32(buckets))
            texts_of.append(owner[:n][whole])
        if found:
            yield a, b, words, np.concatenate(texts_of), np.concatenate(found).astype(np.int64)
        else:
            yield a, b, words, np.zeros(0, np.int64), np.zeros(0, np.int64)


def bucket_counts(corpus: DataFrame, text_col: str, max_words: int, buckets: int) -> np.ndarray:
    """Number of features in each bucket over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in feature_buckets(batch.column(0), max_words, buckets):
                held += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])
        tidy()

    each = corpus.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets."""
    b = float(len(source))
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


WEIGHED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])


def weigh(shared, max_words: int):
    @F.arrow_udf(WEIGHED)
    def weights(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gains = shared.value
        for texts in batches:
            out = []
            for a, b, words, owner, found in feature_buckets(texts, max_words, len(gains)):
                n = np.bincount(owner, minlength=b - a)
                total = np.bincount(owner, gains[found], b - a).astype(np.int64)  # whole numbers below 2**53: exact
                out.append((words, n, total // np.maximum(n, 1)))
            columns = [np.concatenate(c).astype(np.int64) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], names=WEIGHED.names)

    return weights


def noise(id_column: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(seed:id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null"))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


# --- draw ------------------------------------------------------------------------------------
def weighed(documents: DataFrame, target: DataFrame, id_col: str, text_col: str, max_words: int, buckets: int, seed: int) -> DataFrame:
    counts = [bucket_counts(corpus, text_col, max_words, buckets) for corpus in (documents, target)]
    shared = documents.sparkSession.sparkContext.broadcast(bucket_gains(*counts))
    plain = documents.drop("_w", ROW, *RESULTS)
    out = plain.withColumn("_w", weigh(shared, max_words)(F.col(text_col).cast("string")))
    return out.select(*plain.columns, F.col("_w.n_words").alias("_words"), "_w.n_features", "_w.weight", (F.col("_w.weight") + noise(F.col(id_col), seed)).alias("score"))


def ranked(rows: DataFrame, id_col: str, percent: int, least_words: int) -> DataFrame:
    """Rows with ``rank`` 1, 2, 3, ... by score (ties: smaller id, then row number) for the floor(percent * N / 100) best of the N long enough, null for others."""
    spark = rows.sparkSession
    enough = F.col("_words") >= least_words
    drawn = percent * rows.where(enough).count() // 100
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col(ROW)]
    dealt = rows.where(enough).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    numbered_rows = placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), part == F.col("_part"))
    best = numbered_rows.withColumn("rank", F.when(rank <= drawn, rank)).drop("_place", "_part", "_before")
    return best.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def rank(
    documents: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS,
    seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """id, n_features, weight, score and rank (null: not drawn) of every document; texts are read twice and never shuffled."""
    scored = weighed(documents.select(id_col, text_col), target, id_col, text_col, max_words, buckets, seed).drop(text_col)
    return ranked(numbered(scored, "scored", ROW), id_col, percent, least_words).select(id_col, *RESULTS)


def resample(documents: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS,
             seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn documents, with all their columns and n_features, weight, score and rank."""
    rows = numbered(weighed(documents, target, id_col, text_col, max_words, buckets, seed), "scored", ROW)
    best = ranked(rows.select(id_col, "_words", "score", ROW), id_col, percent, least_words).where("rank is not null").select(ROW, "rank")
    return rows.join(best, ROW).drop(ROW, "_words")

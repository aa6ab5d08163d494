"""LM scoring: likelihood of a text under a subword lattice.

A model file's subword vocabulary (pieces) is kept as it is. Pieces follow each other independently; a word begins with the blank that pieces mark it with, a text ends with an end piece.
The probability of a word is the sum over all its segmentations into pieces, by forward recursion in log space, so the probability of a text is
the product over its words and the end. Piece scores start from the file's (ranks, read as Zipf's law) and are fitted to the training words by expectation
maximisation: each round a task sums expected counts over its part of the vocabulary, and one number per piece (a fixed number) reaches the driver. Every
single byte is a piece too, so any text has a probability.

Counting and scoring go by distinct word: tasks reduce blocks of rows to their distinct words, which are summed to the corpus vocabulary with training counts
and the blocks that ask; a word is scored once for each ``SALT_PARTS`` input partitions that hold it, so no row lists more blocks than those have. The answers go back to the blocks that asked, where
the texts are shuffled to once. The longer a text, the fewer rows share its block, so a block holds ``block_rows`` times ``SHORT`` bytes at most, or one text. Nothing but piece scores is broadcast.

Edge cases: null and empty texts are one end token; null ids are scored but not learned from; rows that repeat an id are scored each; without training rows
counts are zero and the initial piece scores remain; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, SPACED, as_bytes, numbered, partitions, per_text, prefix_hashes, slices, span_hashes, stored, unsigned_crc32, word_spans

ROW = "_row"
BLOCK_ROWS = 1 << 12  # rows of up to SHORT bytes are a block; half as many of up to twice that, and so on
SHORT = 1 << 15
SALT_PARTS = 128
CHUNK_BYTES = 16 << 20
ROUNDS = 2
LONG_WORD = 256
SMOOTHING = 0.1
TABLE_BITS = 20


class Pieces:
    """Usable pieces of a vocabulary file as bytes (a word's mark is a blank), found by hash, and their initial log probabilities."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ranks: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            # Texts are lower-cased and words hold no blank: pieces with a capital or an inner blank never fit.
            if any(65 <= b <= 90 for b in piece) or b" " in piece[1:]:
                continue
            ranks[piece] = -model.get_score(i)
        for b in range(256):
            ranks.setdefault(bytes([b]), float(model.get_piece_size()))
        self.pieces = sorted(ranks)
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        weight = np.array([1 / (ranks[p] + 10) for p in self.pieces])
        self.initial = np.log(weight / weight.sum() / 1.01)
        raw = np.frombuffer(b"".join(self.pieces), np.uint8)
        ends = np.cumsum([len(p) for p in self.pieces])
        hashes = span_hashes(prefix_hashes(raw), np.append(0, ends[:-1]), ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.present = np.zeros(1 << TABLE_BITS, bool)
        self.present[self.hashes >> np.uint64(64 - TABLE_BITS)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        maybe = np.nonzero(self.present[hashes >> np.uint64(64 - TABLE_BITS)])
        some = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == some, self.order[at], -1)
        return out


@lru_cache(maxsize=2)
def pieces_of(model_file: str) -> Pieces:
    return Pieces(model_file)


def lattice(pieces: Pieces, logp: np.ndarray, word: bytes) -> tuple[list[float], list[tuple[int, int, int]]]:
    """Forward sums and edges (start, end, piece) of one word, for words of any length."""
    forward, edges = [0.0], []
    for end in range(1, len(word) + 1):
        terms = []
        for start in range(max(0, end - pieces.longest), end):
            piece = pieces.index.get(word[start:end])
            if piece is not None:
                edges.append((start, end, piece))
                terms.append(forward[start] + float(logp[piece]))
        top = max(terms)
        forward.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return forward, edges


def score_words(pieces: Pieces, logp: np.ndarray, words: list[bytes], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each word (with its blank), and the pieces' expected counts under ``weights``.

    Words of one length are scored together, position by position."""
    scores, expected = np.zeros(len(words)), np.zeros(len(pieces.pieces))
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        group = np.flatnonzero(lengths == n)
        if n > LONG_WORD:
            for i in group.tolist():
                forward, edges = lattice(pieces, logp, words[i])
                scores[i] = forward[-1]
                if weights is not None and weights[i]:
                    backward = [-math.inf] * n + [0.0]
                    for start, end, piece in sorted(edges, key=lambda e: -e[0]):
                        backward[start] = float(np.logaddexp(backward[start], float(logp[piece]) + backward[end]))
                    for start, end, piece in edges:
                        expected[piece] += weights[i] * math.exp(forward[start] + float(logp[piece]) + backward[end] - forward[-1])
            continue
        for at in range(0, len(group), 1 << 13):
            some = group[at : at + (1 << 13)]
            m = len(some)
            prefix = prefix_hashes(np.frombuffer(b"".join(words[i] for i in some), np.uint8))
            base = np.arange(m) * n
            # Edges of all words' lattices: where a piece was found, in which words.
            edges, forward = {}, np.full((n + 1, m), -np.inf)
            forward[0] = 0
            for end in range(1, n + 1):
                for start in range(max(0, end - pieces.longest), end):
                    found = pieces.find(span_hashes(prefix, base + start, base + end))
                    has = np.flatnonzero(found >= 0)
                    if len(has):
                        edges[start, end] = has, found[has]
                        forward[end, has] = np.logaddexp(forward[end, has], forward[start, has] + logp[found[has]])
            scores[some] = forward[n]
            if weights is None:
                continue
            backward = np.full((n + 1, m), -np.inf)
            backward[n] = 0
            for start, end in sorted(edges, reverse=True):
                has, found = edges[start, end]
                backward[start, has] = np.logaddexp(backward[start, has], logp[found] + backward[end, has])
            for (start, end), (has, found) in edges.items():
                share = np.exp(forward[start, has] + logp[found] + backward[end, has] - forward[n, has])
                expected += np.bincount(found, share * weights[some[has]], len(expected))
    return scores, expected


def block_of(row: Column, n_bytes: Column, bits: int) -> Column:
    """Number of a row's block: 2**bits rows with numbers close together, fewer the longer the texts; blocks hold lengths of one class."""
    times = F.greatest(n_bytes, F.lit(SHORT)) / F.lit(float(SHORT))
    length_class = F.least(F.lit(min(bits, 15)), F.ceil(F.log2(times))).cast("int")
    return F.call_function("shiftright", row, bits - length_class) * 16 + length_class


def first_row(block: Column, bits: int) -> Column:
    return F.call_function("shiftleft", F.shiftright(block, 4), bits - block.bitwiseAND(F.lit(15)).cast("int"))


def block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each block in a chunk of rows, with the number of times they occur in training rows. Rows may come in any order."""

    def reduced(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        blocks, hashes, train, starts, ends = (np.concatenate(c) for c in list(zip(*found))[:5])
        data = np.concatenate([f[5] for f in found])
        order = np.lexsort((hashes, blocks))
        blocks, hashes = blocks[order], hashes[order]
        heads = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (hashes[1:] != hashes[:-1])))
        counts = np.add.reduceat(train[order].astype(np.int64), heads)
        start, end = starts[order[heads]], ends[order[heads]]
        offsets = np.append(0, np.cumsum(end - start))
        letters = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([words, pa.array(blocks[heads]), pa.array(counts)], names=["word", "block", "count"])

    found, size = [], 0
    for batch in batches:
        raw, offs = as_bytes(batch.column("text"))
        blocks, train = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "train"))
        for a, _, part, at in slices(raw, offs):
            starts, ends, first = word_spans(part, at, SPACED)
            if len(starts):
                owner = a + per_text(first, len(starts))
                found.append((blocks[owner], span_hashes(prefix_hashes(part, lower=True), starts, ends), train[owner], starts + size, ends + size, LOWER[part]))
                size += len(part)
            if size >= CHUNK_BYTES:
                yield from reduced(found)
                found, size = [], 0
    if found:
        yield from reduced(found)


def many(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches joined to at least so many rows: words of one length are scored together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def expectations(shared, model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = pieces_of(model_file), None
        for batch in many(batches):
            words = [b" " + w for w in batch.column("word").to_pylist()]
            _, expected = score_words(pieces, shared.value, words, batch.column("count").to_numpy().astype(float))
            total = expected if total is None else total + expected
        if total is not None:
            has = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["piece", "expected"])

    return run


def answers(shared, model_file: str):
    """Hash, training count and log10 probability of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_file)
        for batch in many(batches):
            words = batch.column("word").to_pylist()
            scores, _ = score_words(pieces, shared.value, [b" " + w for w in words])
            raw, offs = as_bytes(batch.column("word").cast(pa.large_binary()).view(pa.large_string()))
            hashes = span_hashes(prefix_hashes(raw), offs[:-1], offs[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), batch.column("count"), pa.array(scores / math.log(10)), batch.column("blocks")], names=["hash", "count", "score", "blocks"],
            )

    return run


def score_block(train_tokens: int, vocabulary: int, end_count: int, end_score: float):
    """All texts of a block with the answers for its words."""
    least = train_tokens + SMOOTHING * (vocabulary + 1)

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        hashes = words.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes, count, score = hashes[order], words.column("count").to_numpy()[order], words.column("score").to_numpy()[order]
        base = np.log10((count + SMOOTHING) / least) if least else np.zeros(len(count))
        n_tokens, n_known, base_score, model_score = [], [], [], []
        raw, offs = as_bytes(texts.column("text"))
        for a, b, part, at in slices(raw, offs):
            starts, ends, first = word_spans(part, at, SPACED)
            wanted = span_hashes(prefix_hashes(part, lower=True), starts, ends)
            where = np.minimum(np.searchsorted(hashes, wanted), max(len(hashes) - 1, 0))
            if len(wanted) and not (len(hashes) and np.array_equal(hashes[where], wanted)):
                raise ValueError("a word of the block has no answer")
            owner, n = per_text(first, len(where)), b - a
            n_tokens.append(np.diff(first) + 1)
            n_known.append(np.bincount(owner, count[where] > 0, n) + (end_count > 0))
            end_base = math.log10((end_count + SMOOTHING) / least) if least else 0.0
            base_score.append(np.bincount(owner, base[where], n) + end_base)
            model_score.append(np.bincount(owner, score[where], n) + end_score)
        columns = [np.concatenate(x) for x in (n_tokens, n_known, base_score, model_score)]
        return pa.table([
            texts.column("doc_id"), texts.column("held_out"), pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)),
            pa.array(np.full(len(columns[0]), train_tokens)), pa.array(columns[2]), pa.array(columns[3]),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(documents: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the text) of every row; ``block_rows`` is a power of two.

    Rows whose crc32(id) mod 10 is not 0 are learned from."""
    spark, bits = documents.sparkSession, block_rows.bit_length() - 1
    held = F.coalesce(unsigned_crc32(F.col(id_col)) % 10 == 0, F.lit(False))
    rows = numbered(documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"),
        (~held & F.col(id_col).isNotNull()).alias("train"),
    ), "numbered", ROW).withColumn("block", block_of(F.col(ROW), F.octet_length("text"), bits))
    n_parts = partitions(spark)
    asked = rows.select("text", "block", "train").mapInArrow(block_words, "word binary, block long, count long")
    part = F.shiftright(first_row(F.col("block"), bits), 33)  # the partition the rows were numbered in
    salted = asked.withColumn("salt", F.floor(part / SALT_PARTS).cast("long"))
    # Dealt by word once: neither the blocks of a salt nor the sum over a word's few salts needs another exchange.
    asking = salted.repartition(n_parts, "word").groupBy("word", "salt").agg(F.sum("count").alias("part"), F.collect_set("block").alias("blocks"))
    of_word = Window.partitionBy("word")
    vocabulary = stored(asking.select(
        "word", "blocks", F.sum("part").over(of_word).alias("count"), (F.row_number().over(of_word.orderBy("salt")) == 1).alias("head"),
    ), "vocabulary")
    counted = vocabulary.where("count > 0 and head").select("word", "count")
    totals = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    texts = rows.where("train").count()
    tokens, distinct = totals["tokens"] + texts, totals["distinct"] + (texts > 0)
    pieces = pieces_of(model_file)
    logp, end = pieces.initial, math.log(1 - 1 / 1.01)
    for _ in range(rounds if texts else 0):  # few bytes, much work: dealt by number of words, not by size of files
        shared = spark.sparkContext.broadcast(logp)
        sums = counted.repartition(n_parts, "word").mapInArrow(expectations(shared, model_file), "piece long, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).collect()
        expected = np.full(len(pieces.pieces), SMOOTHING)
        for r in sums:
            expected[r["piece"]] += r["expected"]
        logp, end = np.log(expected / (expected.sum() + texts)), math.log(texts / (expected.sum() + texts))
    shared = spark.sparkContext.broadcast(logp)
    replies = vocabulary.select("word", "count", "blocks").mapInArrow(answers(shared, model_file), "hash long, count long, score double, blocks array<long>")
    replies = replies.select(F.explode("blocks").alias("block"), "hash", "count", "score")
    scored = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.select("doc_id", "text", "held_out", "block").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        trimmed(score_block(tokens, distinct, texts, end / math.log(10))), scored,
    )


def trimmed(fn):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left.combine_chunks(), right.combine_chunks())

    return run

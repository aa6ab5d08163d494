"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A paragraph is a line; a section ends at an empty line or after a paragraph whose hash says so (one in eight); a piece ends with its paragraph or after a word whose hash says so
(one in eight), so an edit moves no other cut. A piece's hash is that of its bytes, a node's that of its children's hashes in order, the root a 128-bit BLAKE2 of
the sections'. The fingerprint is the root in hexadecimal and the tree in page order, seven characters a node: its kind (; section, - paragraph, . piece) and
30 bits of its hash and, of a piece, its number of words up to 63, else 6 more bits.

Equal roots mean equal texts. Otherwise ``differing`` descends only into branches whose hashes differ and names the pieces; ``likeness`` is the share of words in
common pieces.

Edge cases: null and empty texts are an empty tree (root of no section), alike only to each other; white space counts; null ids come last, rows that repeat an id
follow each other in table order; extra columns are ignored; a single document's next document is itself.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACED, as_bytes, mix, partitions, prefix_hashes, slices, span_hashes, word_spans

WIDTH = 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def folded(hashes: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Hash of each run of hashes that begins at ``head``, depending on their order."""
    if not len(head):
        return np.zeros(0, np.uint64)
    place = np.arange(len(hashes)) - np.repeat(head, np.diff(np.append(head, len(hashes))))
    return mix(np.add.reduceat(mix(hashes + mix(place.astype(np.uint64) + np.uint64(11))), head) + np.uint64(len("node")))


def letters(hashes: np.ndarray, n: int) -> np.ndarray:
    return np.stack([ALPHABET[((hashes >> np.uint64(6 * i)) & np.uint64(63)).astype(np.int64)] for i in range(n)], axis=1)


def fingerprints(texts: pa.Array) -> list[str]:
    raw, offs = as_bytes(texts)
    out: list[str] = []
    for _, _, part, at in slices(raw, offs):
        out += some_fingerprints(part, at)
    return out


def some_fingerprints(raw: np.ndarray, offs: np.ndarray) -> list[str]:
    filled = np.flatnonzero(np.diff(offs) > 0)
    if not len(filled):
        return [hashlib.blake2b(b"", digest_size=16).hexdigest()] * (len(offs) - 1)
    prefix = prefix_hashes(raw)
    starts, ends, _ = word_spans(raw, offs, SPACED)
    words = span_hashes(prefix, starts, ends)
    lines = np.flatnonzero(raw == 10) + 1
    paragraph = np.union1d(offs[filled], lines[lines < len(raw)])
    cuts = np.flatnonzero((words[:-1] & np.uint64(7)) == 0) + 1
    piece = np.union1d(paragraph, starts[cuts])
    stop = np.append(piece[1:], len(raw))
    piece_hash = span_hashes(prefix, piece, stop)
    n_words = np.searchsorted(starts, stop) - np.searchsorted(starts, piece)
    paragraph_at = np.searchsorted(piece, paragraph)
    paragraph_hash = folded(piece_hash, paragraph_at)
    line_end = np.append(paragraph[1:], len(raw))
    ends_section = ((paragraph_hash >> np.uint64(8)) & np.uint64(7) == 0) | (line_end - paragraph == 1)
    new = np.append(True, ends_section[:-1])
    new[np.searchsorted(paragraph, offs[filled])] = True
    section_at = np.flatnonzero(new)
    section_hash = folded(paragraph_hash, section_at)
    # Positions of the nodes in one row of tokens: a section, its first paragraph, its first piece, ...
    opens_paragraph = np.zeros(len(piece), np.int64)
    opens_paragraph[paragraph_at] = 1
    opens_section = np.zeros(len(piece), np.int64)
    opens_section[paragraph_at[section_at]] = 1
    place = np.arange(len(piece)) + np.cumsum(opens_paragraph) + np.cumsum(opens_section)
    tokens = np.zeros((int(place[-1]) + 1, WIDTH), np.uint8)
    tokens[place, 0] = ord(".")
    tokens[place, 1:6] = letters(piece_hash, 5)
    tokens[place, 6] = ALPHABET[np.minimum(n_words, 63)]
    for kind, where, hashes in ((b"-", place[paragraph_at] - 1, paragraph_hash), (b";", place[paragraph_at[section_at]] - 2, section_hash)):
        tokens[where, 0] = kind[0]
        tokens[where, 1:] = letters(hashes, 6)
    text_of_piece = np.searchsorted(piece, offs[filled])
    first = place[text_of_piece] - 2
    last = np.append(first[1:], len(tokens))
    section_first = np.searchsorted(piece[paragraph_at[section_at]], offs[filled])
    section_last = np.append(section_first[1:], len(section_at))
    out = [hashlib.blake2b(b"", digest_size=16).hexdigest()] * (len(offs) - 1)
    for text, a, b, c, d in zip(filled.tolist(), first.tolist(), last.tolist(), section_first.tolist(), section_last.tolist()):
        out[text] = hashlib.blake2b(section_hash[c:d].tobytes(), digest_size=16).hexdigest() + tokens[a:b].tobytes().decode()
    return out


def nodes(fingerprint: str) -> list[str]:
    return [fingerprint[i : i + WIDTH] for i in range(32, len(fingerprint), WIDTH)]



WEIGHTS = {chr(c): max(1, i) for i, c in enumerate(ALPHABET.tolist())}


def likeness(a: str, b: str) -> float:
    """Twice the words of common pieces over the words of both; 1 for equal roots."""
    if a[:32] == b[:32]:
        return 1.0
    left, right = (Counter(n for n in nodes(x) if n[0] == ".") for x in (a, b))
    total = sum(WEIGHTS[p[6]] * n for c in (left, right) for p, n in c.items())
    common = sum(WEIGHTS[p[6]] * min(n, right[p]) for p, n in left.items() if p in right)
    return min(2 * common / total, 1.0) if total else 0.0


def tree(fingerprint: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    sections: list[tuple[str, list[tuple[str, list[str]]]]] = []
    for n in nodes(fingerprint):
        if n[0] == ";":
            sections.append((n, []))
        elif n[0] == "-":
            sections[-1][1].append((n, []))
        else:
            sections[-1][1][-1][1].append(n)
    return sections


def differing(a: str, b: str) -> list[tuple[int, int, int]]:
    """Where ``a`` differs from ``b``: (section, paragraph, piece) numbers of its pieces that ``b`` lacks. Only branches with different hashes are opened."""
    if a[:32] == b[:32]:
        return []
    theirs = tree(b)
    sections = {s for s, _ in theirs}
    paragraphs = {p for _, ps in theirs for p, _ in ps}
    pieces = {x for _, ps in theirs for _, xs in ps for x in xs}
    return [
        (i, j, k)
        for i, (s, ps) in enumerate(tree(a)) if s not in sections
        for j, (p, xs) in enumerate(ps) if p not in paragraphs
        for k, x in enumerate(xs) if x not in pieces
    ]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and place; the row after a text in its bucket is its next document. Rows at the bucket's odd place, of which equal rows
    may give several, only serve as such."""

    def finished(docs: list, texts: list[str], places: list, prints: list[str]) -> pa.RecordBatch:
        here = [i for i in range(len(texts) - 1) if places[i] % 2 == 0 and places[i] // 2 == places[i + 1] // 2]
        changed = [edited(texts[i], texts[i + 1]) for i in here]
        changed_prints = fingerprints(pa.array(changed, pa.large_string()))
        columns = [
            pa.array([docs[i] for i in here], pa.int64()), pa.array([len(texts[i]) for i in here], pa.int64()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
            pa.array([prints[i] for i in here], pa.string()), pa.array(changed_prints, pa.string()),
            pa.array([likeness(prints[i], c) for i, c in zip(here, changed_prints)], pa.float64()), pa.array([likeness(prints[i], prints[i + 1]) for i in here], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in EDITED.split(", ")])

    last: tuple[list, list, list, list] = ([], [], [], [])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [t or "" for t in part.column("text").to_pylist()]
            prints = fingerprints(pa.array(texts, pa.large_string()))
            now = part.column("doc_id").to_pylist(), texts, part.column("place").to_pylist(), prints
            joined = [a + b for a, b in zip(last, now)]
            yield finished(*joined)
            last = tuple(x[-1:] for x in now)


def compare_with_edits(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document in descending id order, cyclically.

    Texts are shuffled once, into buckets of consecutive ids; a bucket's first document also goes to the bucket before it. Bucket bounds and first documents, a few
    numbers for each partition, are all that passes the driver. Rows are told apart by id and text, never by a number that another scan may give anew; rows equal in both are interchangeable."""
    spark = documents.sparkSession
    n = 4 * partitions(spark)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"))
    steps = F.array(*[F.lit((i + 1) / n) for i in range(n - 1)])
    bounds = np.unique(np.array(rows.agg(F.approx_percentile("doc_id", steps, F.lit(10 * n)).alias("b")).first()["b"] or [], np.int64))

    @F.arrow_udf("long")
    def bucket_of(ids: pa.Array) -> pa.Array:
        # Ascending buckets hold descending ids; null ids come last.
        low = ids.fill_null(0).to_numpy(zero_copy_only=False)
        bucket = len(bounds) - np.searchsorted(bounds, low, side="left")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, bucket))

    placed = rows.withColumn("bucket", bucket_of("doc_id"))
    order = F.struct((-F.col("doc_id")).alias("doc"), "tie")
    heads = placed.select("bucket", order.alias("o")).groupBy("bucket").agg(F.min("o").alias("o")).select("bucket", "o.*").orderBy("bucket").collect()
    before = {(None if h["doc"] is None else -h["doc"], h["tie"]): heads[i - 1]["bucket"] for i, h in enumerate(heads)}

    @F.arrow_udf("array<long>")
    def also(buckets: pa.Array, ids: pa.Array, ties: pa.Array) -> pa.Array:
        # The copy that closes a bucket gets an odd place, so that it is told from the bucket's own rows.
        keys = zip(ids.to_pylist(), ties.to_pylist())
        return pa.array([[2 * b, 2 * before[k] + 1] if k in before else [2 * b] for b, k in zip(buckets.to_pylist(), keys)], pa.list_(pa.int64()))

    spread = rows.withColumn("place", F.explode(also(bucket_of("doc_id"), "doc_id", "tie"))).withColumn("bucket", F.floor(F.col("place") / 2).cast("long"))
    ordered = spread.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "place", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return ordered.select("doc_id", "text", "place").mapInArrow(compare_in_order, EDITED)

"""Suffix-array dedup: bytes covered by a ``depth``-byte string that also starts earlier in the corpus.

Depth-limited most-significant-digit radix sort of suffixes. Suffixes are entered at anchors only: the anchor of a window of ``depth``
bytes is its minimizer, the position of the smallest hash among its ``gram``-byte strings (leftmost of equals). It depends on the
window's bytes alone, so equal windows have equal anchors at equal offsets, and one suffix in about (depth - gram) / 2 enters the sort.

1. First digit: the gram at the anchor. A gram that occurs once repeats nowhere and leaves the sort.
2. Second digit: the rest of the run of windows that share the anchor, down to ``depth``. All but the first of equal runs are repeats.
3. Runs that agree in the first digit only are compared window by window: all but the first of equal windows are repeats.

Order is by (doc_id, position of the row in the table, offset); digits are compared by 64-bit hashes, two of which agree for every reported repeat.
Every task combines what it has read before it shuffles, so a key gets at most ``FEW`` rows from a chunk however often it occurs;
grams with more than ``MANY`` different runs are dealt out by window. Texts are shuffled once, by row, and that exchange is read twice.

Edge cases: null and empty texts are zero bytes; texts shorter than ``depth`` keep all bytes; null doc_ids come first; rows that repeat a doc_id are separate
texts in table order; extra columns pass through, but those named like a result column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import as_bytes, mix, numbered, partitions, prefix_hashes, slices, span_hashes, stored

DEPTH = 100
GRAM = 32
CHUNK_BYTES = 32 << 20
FEW = 64
MANY = 256
POSITION_BITS = 24
COVERED, RUN, COMMON, SORTED, SHARED = 0, 1, 2, 3, 4
ROW = "_row"
DEALT = "deal long, kind byte, digit long, doc long, row long, span long"
WINDOWS = "deal long, doc long, row long, start long, offset long, bytes binary"
SPAN = "row long, start long, end long"


def anchor_runs(raw: np.ndarray, offs: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: first window, number of windows, anchor, hash of the gram, hash of the run, text."""
    if len(raw) < depth:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    prefix = prefix_hashes(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = span_hashes(prefix, at, at + gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (grams & ~low) | at.astype(np.uint64)
    width, size = depth - gram + 1, 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    inside = np.arange(len(anchor)) + depth <= offs[owner + 1]
    start = inside.copy()
    start[1:] &= (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(start)
    breaks = np.append(np.flatnonzero(start | ~inside), len(anchor))
    count = breaks[np.searchsorted(breaks, first, side="right")] - first
    a = anchor[first]
    return first, count, a, grams[a], span_hashes(prefix, first, first + count + depth - 1) ^ mix((a - first).astype(np.uint64)), owner[first]


def pieces(raw: np.ndarray, offs: np.ndarray, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of whole texts; one longer than the position bits allow comes in parts that overlap by a window less one byte.

    Yields the first row, the offset of the part in its text, bytes and offsets."""
    limit = 1 << (POSITION_BITS - 1)
    for row, _, part, at in slices(raw, offs):
        if len(part) <= limit:
            yield row, 0, part, at
            continue
        for base in range(0, len(part) - depth + 1, limit):
            piece = part[base : base + limit + depth - 1]
            yield row, base, piece, np.array([0, len(piece)])


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals of each row (intervals of one row need not be sorted)."""
    order = np.lexsort((end, start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    change = np.append(True, row[1:] != row[:-1])
    group = np.cumsum(change) - 1
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * step) - group * step
    new = change.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return row[at], start[at], reach[np.append(at[1:], len(row)) - 1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def record(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


DEALT_NAMES = ["deal", "kind", "digit", "doc", "row", "span"]


def passed(kind: int, digit: np.ndarray, doc: np.ndarray, row: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    """Rows that only pass through the next exchange, dealt evenly."""
    deal = signed(mix(row.astype(np.uint64) * np.uint64(1 << 20) + span.astype(np.uint64)))
    return record(DEALT_NAMES, deal, np.full(len(row), kind, np.int8), digit, doc, row, span)


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def pack(start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start << 24) | (count << 12) | offset


def unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return span >> 24, (span >> 12) & 0xFFF, span & 0xFFF


def enter(depth: int, gram: int):
    """Anchors of the texts, combined within chunks."""

    def combined(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        digit, run, doc, row, span = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((span, row, doc, run, digit))
        digit, run, doc, row, span = digit[order], run[order], doc[order], row[order], span[order]
        later = same_as_before(digit, run)
        start, count, _ = unpack(span[later])
        covered_row, a, b = joined(row[later], start, start + count + depth - 1)
        if len(covered_row):
            yield passed(COVERED, b, np.zeros(len(b), np.int64), covered_row, a)
        keep = ~later
        digit, run, doc, row, span = digit[keep], run[keep], doc[keep], row[keep], span[keep]
        head = np.flatnonzero(~same_as_before(digit))
        sizes = np.diff(np.append(head, len(digit)))
        many = np.repeat(sizes > FEW, sizes)
        kind = np.full(len(digit), SORTED, np.int8)
        kind[head[sizes > FEW]] = SHARED
        direct = many & (kind == SORTED)
        if direct.any():
            yield passed(COMMON, digit[direct], doc[direct], row[direct], span[direct])
        yield record(DEALT_NAMES, digit[~direct], kind[~direct], run[~direct], doc[~direct], row[~direct], span[~direct])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            raw, offs = as_bytes(batch.column("text"))
            docs, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", ROW))
            for row, base, part, at in pieces(raw, offs, depth):
                first, count, anchor, grams, runs, owner = anchor_runs(part, at, depth, gram)
                if len(first):
                    found.append((signed(grams), signed(runs), docs[row + owner], rows[row + owner], pack(first - at[owner] + base, count, anchor - first)))
                size += len(part)
                if size >= CHUNK_BYTES and found:
                    yield from combined(found)
                    found, size = [], 0
        if found:
            yield from combined(found)

    return run


def by_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, re-cut so that no group of equal keys is split."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut or (kept and kept[-1].column(key)[-1].as_py() != keys[0]):
            if kept and kept[-1].column(key)[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept = []
            if cut:
                yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
                kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def second_digit(depth: int):
    """Sorted by (deal, digit, doc, row, span): repeats of whole runs, and the runs whose gram has others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_groups(batches, "deal"):
            deal, kind, digit, doc, row, span = (batch.column(c).to_numpy() for c in DEALT_NAMES)
            through = kind < SORTED
            if through.any():
                yield record(["kind", "digit", "doc", "row", "span"], kind[through], digit[through], doc[through], row[through], span[through])
            deal, kind, digit, doc, row, span = (x[~through] for x in (deal, kind, digit, doc, row, span))
            if not len(deal):
                continue
            later = same_as_before(deal, digit)
            group = np.cumsum(~same_as_before(deal)) - 1
            shared = np.bincount(group, kind == SHARED)
            runs = np.bincount(group, ~later) + shared
            onward = np.where((shared > 0) | (runs > MANY), COMMON, RUN).astype(np.int8)
            start, count, _ = unpack(span[later])
            if later.any():
                yield record(["kind", "digit", "doc", "row", "span"], np.full(later.sum(), COVERED, np.int8), start + count + depth - 1, doc[later], row[later], start)
            others = ~later & (runs[group] > 1)
            if others.any():
                yield record(["kind", "digit", "doc", "row", "span"], onward[group[others]], deal[others], doc[others], row[others], span[others])

    return run


def read_runs(depth: int):
    """Bytes of the runs that go on, one row each; runs of common grams as one row for each window, combined within the chunk."""
    names = ["deal", "doc", "row", "start", "offset", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = as_bytes(batch.column("text"))
            rows = batch.column(ROW).to_numpy()
            runs = batch.column("runs")
            owner = np.repeat(np.arange(len(rows)), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            digit, span, doc = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("digit", "span", "doc"))
            common = flat.field("common").to_numpy(zero_copy_only=False)
            start, count, offset = unpack(span)
            base = offs[owner]
            plain = np.flatnonzero(~common)
            if len(plain):
                a, n = (base + start)[plain], (count + depth - 1)[plain]
                ends = np.cumsum(n)
                index = np.repeat(a - (ends - n), n) + np.arange(ends[-1])
                content = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(plain), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(raw[index])]
                ).cast(pa.binary())
                yield record(names, digit[plain], doc[plain], rows[owner[plain]], start[plain], offset[plain], content)
            hot = np.flatnonzero(common)
            if len(hot):
                which = np.repeat(hot, count[hot])
                step = np.arange(len(which)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
                prefixes = np.zeros(len(which), np.uint64)
                for first, end, part, at in slices(raw, offs):
                    here = (owner[which] >= first) & (owner[which] < end)
                    if here.any():
                        a = base[which[here]] - offs[first] + start[which[here]] + step[here]
                        prefixes[here] = span_hashes(prefix_hashes(part), a, a + depth)
                deal = signed(mix(prefixes + mix(digit[which].view(np.uint64) + (offset[which] - step).astype(np.uint64))))
                d, r, s = doc[which], rows[owner[which]], start[which] + step
                order = np.lexsort((s, r, d, deal))
                deal, d, r, s = deal[order], d[order], r[order], s[order]
                later = same_as_before(deal)
                covered_row, a, b = joined(r[later], s[later], s[later] + depth)
                if len(covered_row):
                    deal_through = signed(mix(covered_row.astype(np.uint64) * np.uint64(1 << 20) + a.astype(np.uint64)))
                    yield record(names, deal_through, np.zeros(len(a), np.int64), covered_row, a, -b, pa.array([b""] * len(a), pa.binary()))
                keep = ~later
                yield record(names, deal[keep], d[keep], r[keep], s[keep], np.zeros(keep.sum(), np.int64), pa.array([b""] * int(keep.sum()), pa.binary()))

    return run


def compare_windows(depth: int):
    """Sorted by (deal, doc, row, start): intervals of windows that an earlier run of the group has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_groups(batches, "deal"):
            deal, row, start, offset = (batch.column(c).to_numpy() for c in ("deal", "row", "start", "offset"))
            through = offset < 0
            if through.any():
                yield record(["row", "start", "end"], row[through], start[through], -offset[through])
            contents = batch.column("bytes").cast(pa.large_binary()).view(pa.large_string())
            raw, offs = as_bytes(contents)
            if not through.all():
                prefix = prefix_hashes(raw)
                n = np.maximum(np.diff(offs) - depth + 1, 1)
                n[through] = 0
                which = np.repeat(np.arange(len(row)), n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                whole = np.diff(offs)[which] > 0
                window = np.zeros(len(which), np.uint64)
                a = offs[which[whole]] + step[whole]
                window[whole] = span_hashes(prefix, a, a + depth) ^ mix((offset[which[whole]] - step[whole]).astype(np.uint64))
                group = np.cumsum(~same_as_before(deal))[which]
                order = np.lexsort((window, group))
                later = np.zeros(len(which), bool)
                later[order] = same_as_before(group[order], window[order])
                at_row, s = row[which[later]], (start[which] + step)[later]
                if len(s):
                    yield record(["row", "start", "end"], *joined(at_row, s, s + depth))

    return run


def repeated_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(texts with their row number, dealt by it; intervals (row, start, end) of bytes to remove, not yet united)."""
    if not gram < depth < 1 << 11:
        raise ValueError("gram < depth < 2048 is required")
    n = partitions(documents.sparkSession)
    rows = numbered(documents, "numbered", ROW)
    texts = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(text_col).cast("string").alias("text"), ROW)
    entered = texts.mapInArrow(enter(depth, gram), DEALT)
    sorted_runs = entered.repartition(n, "deal").sortWithinPartitions("deal", "digit", "doc", "row", "span")
    verdicts = stored(sorted_runs.mapInArrow(second_digit(depth), "kind byte, digit long, doc long, row long, span long"), "suffix-runs")
    runs = verdicts.where(F.col("kind").isin(RUN, COMMON)).withColumn("common", F.col("kind") == COMMON)
    each = runs.groupBy(F.col("row").alias(ROW)).agg(F.collect_list(F.struct("digit", "span", "doc", "common")).alias("runs"))
    dealt = rows.repartition(n, ROW)
    contents = dealt.select(ROW, F.col(text_col).cast("string").alias("text")).join(each, ROW).mapInArrow(read_runs(depth), WINDOWS)
    compared = contents.repartition(n, "deal").sortWithinPartitions("deal", "doc", "row", "start").mapInArrow(compare_windows(depth), SPAN)
    covered = verdicts.where(F.col("kind") == COVERED).select("row", F.col("span").alias("start"), F.col("digit").alias("end"))
    return dealt, covered.unionByName(compared)


RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept", T.BinaryType()),
])


@F.arrow_udf(RESULT)
def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    raw, offs = as_bytes(texts)
    data, bounds = memoryview(raw), offs.tolist()
    n_bytes, removed, n_spans, kept = [], [], [], []
    for i, holes in enumerate(spans.to_pylist()):
        text, at, parts, runs = data[bounds[i] : bounds[i + 1]], 0, [], 0
        for hole in sorted((h["start"], h["end"]) for h in holes or ()):
            if hole[0] > at or not runs:
                parts.append(text[at : hole[0]])
                runs += 1
            at = max(at, hole[1])
        content = b"".join([*parts, text[at:]])
        n_bytes.append(len(text))
        removed.append(len(text) - len(content))
        n_spans.append(runs)
        kept.append(content)
    return pa.StructArray.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=RESULT.names)


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """``documents`` with ``n_bytes``, ``n_removed``, ``n_spans`` (removed runs) and ``kept`` (remaining bytes, which may split a character)."""
    dealt, spans = repeated_spans(documents, id_col=id_col, text_col=text_col, depth=depth, gram=gram)
    each = spans.groupBy(F.col("row").alias(ROW)).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    out = dealt.join(each, ROW, "left").withColumn("_cut", without(F.col(text_col).cast("string"), F.col("_spans")))
    return out.withColumns({c: F.col("_cut")[c] for c in RESULT.names}).drop("_cut", "_spans", ROW)

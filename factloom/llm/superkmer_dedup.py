"""Substring dedup by super-k-mers: words covered by a window of ``k`` words that also starts in a document with a smaller id.

A window's minimiser is the ``m``-word run with the smallest hash among those inside it (leftmost of equals). Neighbouring windows mostly share it; such a run of windows travels as one packed
string, its words joined by one blank, to the bin of the minimiser's hash. The minimiser depends on the window's words alone, so equal windows meet in one bin, where sorting finds them.

1. Tasks cut texts into super-k-mers and combine chunks of them: of equal strings those of the smallest document of the chunk travel on, the words of the others are known to repeat. What goes
   from a chunk to a bin is one row, compressed with zstandard.
2. A task reads its bins one after another and sorts each by (minimiser, string, document). Of equal strings all that do not stand in the first document are repeats. The different strings of one
   minimiser are cut into windows, which are sorted and compared exactly, byte by byte. What a bin holds is sorted and combined each time ``BIN_BYTES`` have come in.
3. A minimiser with more than ``FEW`` different strings in a chunk or ``MANY`` in its bin is too common for one task: its windows leave the bin for an exchange of their own, dealt by a 128-bit digest of
   the window and sorted by document, where a task remembers no more than the window before.
4. Intervals of repeated words meet the texts, which are shuffled once. Rows are told apart by id and a 64-bit hash of the text: rows equal in both lose the same words.

There are ``BINS`` bins for each shuffle partition, so a bin holds about three times the text divided by that number; a common minimiser adds ``FEW`` strings for each chunk of input, combined as they come.

Edge cases: null and empty texts have no words; texts of fewer than ``k`` words keep all; a null id is smaller than all others; rows that repeat an id are texts of one document, which do not repeat each other;
words of any length are compared whole; texts of any length are cut in overlapping parts; extra columns pass through, but those named like a result column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import SLICE_BYTES, SPACED, as_bytes, mix, partitions, per_text, prefix_hashes, run_hashes, slices, span_hashes, stored, tidy, word_spans

WINDOW, MINIMISER = 13, 2
CHUNK_BYTES, PART_BYTES, BIN_BYTES, SLICE, SEND_ROWS = 16 << 20, 4 << 20, 32 << 20, 2 << 20, 20_000
FEW, MANY, BINS = 64, 4096, 8
POSITION_BITS = 24
DOC, HASH = "_doc", "_hash"
RUN, DIGEST, SPAN = 0, 1, 2
BINNED = "bin long, kind byte, packed binary"
JUDGED = "kind byte, deal long, second long, doc long, row long, start long, end long"
SPANS = "doc long, row long, start long, end long"
BLANK = np.ones(256, bool)
BLANK[0x20] = False


# --- words -------------------------------------------------------------------------------------
def parts_of(raw: np.ndarray, offs: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, words of its text before the part, bytes and offsets. Texts longer than PART_BYTES come in parts that overlap by k - 1 words."""
    for row, _, part, at in slices(raw, offs, min(SLICE_BYTES, PART_BYTES)):
        if len(part) <= PART_BYTES:
            yield row, 0, part, at
            continue
        begin, base, size = 0, 0, PART_BYTES
        while True:
            end = begin + size
            while end < len(part):  # on to the end of the word
                blanks = np.flatnonzero(~SPACED[part[end : end + PART_BYTES]])
                if len(blanks):
                    end += int(blanks[0])
                    break
                end += PART_BYTES
            piece = part[begin:end]
            bounds = np.array([0, len(piece)])
            if end >= len(part):
                yield row, base, piece, bounds
                break
            starts, _, _ = word_spans(piece, bounds, SPACED)
            if len(starts) < k:  # very long words or runs of blanks
                size *= 2
                continue
            yield row, base, piece, bounds
            again = len(starts) - (k - 1)
            begin, base, size = begin + int(starts[again]) if k > 1 else end, base + again, PART_BYTES


def packed(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one blank after each: bytes, start of each word and its end."""
    sizes = ends - starts + 1
    after = np.cumsum(sizes)
    out = np.append(part, np.uint8(0x20))[np.arange(after[-1] if len(after) else 0) + np.repeat(starts - (after - sizes), sizes)]
    out[after - 1] = 0x20
    return out, after - sizes, after - 1


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of packed words: a sum of one mixed value for each byte at its place in the word, end included."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(text)) - np.repeat(starts, ends - starts + 1)
    return mix(np.add.reduceat(mix((place.astype(np.uint64) << np.uint64(8)) | text), starts))


def super_kmers(part: np.ndarray, offs: np.ndarray, k: int, m: int):
    """Packed words and their bounds, then of each run of windows: first window, number of windows, minimiser, digest, text."""
    starts, ends, first_of = word_spans(part, offs, SPACED)
    text, starts, ends = packed(part, starts, ends)
    n = len(starts)
    if n < k:
        none = np.zeros(0, np.int64)
        return text, starts, ends, (none, none, none, none, none), first_of
    hashes = word_hashes(text, starts, ends)
    grams, windows = run_hashes(hashes, m), run_hashes(hashes, k, 1)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least, width, size = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), k - m + 1, 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & low).astype(np.int64)
    owner = per_text(first_of, n)[: len(anchor)]
    inside = np.arange(len(anchor)) + k <= first_of[owner + 1]
    head = inside.copy()
    head[1:] &= (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(head)
    breaks = np.append(np.flatnonzero(head | ~inside), len(anchor))
    count = breaks[np.searchsorted(breaks, first, side="right")] - first
    digest = mix(windows[first] * np.uint64(0x9E3779B97F4A7C15) + mix(windows[first + count - 1]) + count.astype(np.uint64))  # both ends cover all words
    return text, starts, ends, (first, count, grams[anchor[first]].view(np.int64), digest.view(np.int64), owner[first]), first_of


def cut_out(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as one binary array."""
    sizes = end - start
    ends = np.cumsum(sizes)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(text[index])])


def windows_of(runs: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """Windows of packed strings: the string, the number of the window in it, two digests, first and end byte; and all bytes."""
    raw, offs = as_bytes(runs.view(pa.large_string()))
    starts, ends, first_of = word_spans(raw, offs, BLANK)
    text, at, _ = packed(raw, starts, ends)
    hashes = word_hashes(text, at, at + ends - starts)
    owner, n = per_text(first_of, len(starts)), len(starts) - k + 1
    whole = np.flatnonzero(owner[:n] == owner[k - 1 :]) if n > 0 else np.zeros(0, np.int64)
    one, two = (run_hashes(hashes, k, seed)[whole].view(np.int64) for seed in (1, 2))
    return owner[whole], whole - first_of[owner[whole]], one, two, starts[whole], ends[whole + k - 1] if n > 0 else whole, raw


# --- rows ----------------------------------------------------------------------------------------
def packed_rows(strings: pa.Array | None, *columns: np.ndarray) -> bytes:
    """64-bit columns, transposed into byte planes, and strings in one compressed value."""
    parts = [np.array([len(columns[0])], np.int64).tobytes()]
    parts += [np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    if strings is not None:
        raw, offs = as_bytes(strings.view(pa.large_string()))
        parts += [np.ascontiguousarray(np.diff(offs).view(np.uint8).reshape(-1, 8).T).tobytes(), raw.tobytes()]
    return zstandard.compress(b"".join(parts), 3)


def unpacked_rows(value: bytes, n_columns: int, strings: bool) -> tuple[list[np.ndarray], pa.Array | None]:
    data = np.frombuffer(zstandard.decompress(value), np.uint8)
    n, at, columns = int(data[:8].view(np.int64)[0]), 8, []
    for _ in range(n_columns + strings):
        columns.append(np.ascontiguousarray(data[at : at + 8 * n].reshape(8, n).T).view(np.int64).ravel())
        at += 8 * n
    if not strings:
        return columns, None
    offsets = np.append(0, np.cumsum(columns.pop()))
    return columns, pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at:]))])


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours (wrapping), which ``cumsum`` undoes."""
    return np.diff(values.view(np.uint64), prepend=np.uint64(0)).view(np.int64)


def sums(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values.view(np.uint64), dtype=np.uint64).view(np.int64)


def record(schema: str, n: int, **columns) -> Iterator[pa.RecordBatch]:
    """Rows of ``schema`` with the given columns; the others are zero."""
    arrays, names = [], []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        arrays.append(pa.array(np.broadcast_to(columns.get(name, 0), n).astype(np.int8 if kind == "byte" else np.int64)))
        names.append(name)
    batch = pa.RecordBatch.from_arrays(arrays, names=names)
    for at in range(0, n, SEND_ROWS):
        yield batch.slice(at, SEND_ROWS)


def united(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the intervals of each row."""
    if not len(row):
        return doc, row, start, end
    order = np.lexsort((start, row, doc))
    doc, row, start, end = doc[order], row[order], start[order], end[order]
    change = np.append(True, (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]))
    group, step = np.cumsum(change) - 1, int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * step) - group * step
    at = np.flatnonzero(np.append(True, change[1:] | (start[1:] > reach[:-1])))
    return doc[at], row[at], start[at], reach[np.append(at[1:], len(row)) - 1]


def like_before(*columns: np.ndarray) -> np.ndarray:
    """Rows that equal the row before in all columns."""
    same = np.zeros(len(columns[0]), bool)
    if len(same) > 1:
        same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return same


def equal_neighbours(strings: pa.Array) -> np.ndarray:
    same = np.zeros(len(strings), bool)
    if len(same) > 1:
        same[1:] = pc.equal(strings.slice(1), strings.slice(0, len(same) - 1)).to_numpy(zero_copy_only=False)
    return same


def sizes_of(heads: np.ndarray) -> np.ndarray:
    """Of each row the size of its group; ``heads`` marks the groups' first rows, row 0 is one."""
    sizes = np.diff(np.append(np.flatnonzero(heads), len(heads)))
    return np.repeat(sizes, sizes)


def first_value(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Of each row the value of the head of its group; row 0 is a head."""
    at = np.flatnonzero(heads)
    return np.repeat(values[at], np.diff(np.append(at, len(values))))


# --- super-k-mers ------------------------------------------------------------------------------------
class Strings:
    """Super-k-mers: minimiser and document, row and first word of each, digest and string."""

    def __init__(self, key, doc, row, start, digest, runs):
        self.columns, self.runs = [key, doc, row, start, digest], runs
        self.key, self.doc, self.row, self.start, self.digest = self.columns

    def __len__(self) -> int:
        return len(self.key)

    def take(self, which: np.ndarray) -> Strings:
        which = np.flatnonzero(which) if which.dtype == bool else which
        return Strings(*(c[which] for c in self.columns), self.runs.take(pa.array(which)))

    @staticmethod
    def joined(parts: list[Strings]) -> Strings:
        return Strings(*(np.concatenate(c) for c in zip(*(p.columns for p in parts))), pa.concat_arrays([p.runs for p in parts]))

    def slices(self) -> Iterator[Strings]:
        """Runs of whole groups of one minimiser of about SLICE bytes; sorted by minimiser."""
        offs = as_bytes(self.runs.view(pa.large_string()))[1]
        heads, at = np.append(np.flatnonzero(~like_before(self.key)), len(self)), 0
        while at < len(self):
            end = heads[max(np.searchsorted(heads, at, side="right"), np.searchsorted(offs[heads], offs[at] + SLICE, side="right") - 1)]
            yield self.take(np.arange(at, end))
            at = end


def combined(found: Strings, k: int) -> tuple[Strings, np.ndarray, tuple[np.ndarray, ...]]:
    """Sorted strings of the smallest document that has them, the number of different ones of each minimiser, and the spans of all others."""
    found = found.take(np.lexsort((found.start, found.row, found.doc, found.digest, found.key)))
    same = like_before(found.key, found.digest) & equal_neighbours(found.runs)
    later = found.doc > first_value(found.doc, ~same)
    gone = found.take(later)
    words = pc.add(pc.count_substring(gone.runs, " "), 1).to_numpy(zero_copy_only=False) if len(gone) else np.zeros(0, np.int64)
    kept, heads = found.take(~later), ~same[~later]  # the head of equal strings is never later
    groups = ~like_before(kept.key)
    different = np.repeat(np.add.reduceat(heads.astype(np.int64), np.flatnonzero(groups)), np.diff(np.append(np.flatnonzero(groups), len(kept))))
    return kept, different, united(gone.doc, gone.row, gone.start, gone.start + words)


def digested(some: Strings, k: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Windows of too common minimisers: (digest, second digest, document, row, start) of those in the first document, and the spans of the others."""
    kept, spans = [], []
    for part in some.slices():
        which, step, one, two, *_ = windows_of(part.runs, k)
        doc, row, start = part.doc[which], part.row[which], part.start[which] + step
        order = np.lexsort((start, row, doc, two, one))
        one, two, doc, row, start = (x[order] for x in (one, two, doc, row, start))
        later = doc > first_value(doc, ~like_before(one, two))
        spans.append(united(doc[later], row[later], start[later], start[later] + k))
        kept.append([x[~later] for x in (one, two, doc, row, start)])
    return tuple(np.concatenate(c) for c in zip(*kept)), united(*(np.concatenate(c) for c in zip(*spans)))


def compared(some: Strings, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans of windows that a smaller document has in another string of the minimiser, by sorting and comparing bytes."""
    for part in some.slices():
        which, step, one, two, a, b, raw = windows_of(part.runs, k)
        order = np.lexsort((part.doc[which], two, one, part.key[which]))
        which, step, one, two, a, b = (x[order] for x in (which, step, one, two, a, b))
        same = like_before(part.key[which], one, two)
        at = np.flatnonzero(same)
        if not len(at):
            continue
        if not pc.all(pc.equal(cut_out(raw, a[at], b[at]), cut_out(raw, a[at - 1], b[at - 1]))).as_py():
            raise ValueError("two different windows have the same 128-bit digest")
        later = part.doc[which] > first_value(part.doc[which], ~same)
        w, start = which[later], part.start[which[later]] + step[later]
        yield united(part.doc[w], part.row[w], start, start + k)


# --- tasks -----------------------------------------------------------------------------------------
def binned(bins: np.ndarray, kind: int, columns: list[np.ndarray], strings: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """One row for each bin."""
    order = np.argsort(bins, kind="stable")
    bins, columns = bins[order], [c[order] for c in columns]
    strings = None if strings is None else strings.take(pa.array(order))
    heads = np.append(np.flatnonzero(~like_before(bins)), len(bins))
    values = [packed_rows(None if strings is None else strings.slice(a, b - a), *(c[a:b] for c in columns)) for a, b in zip(heads[:-1], heads[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(bins[heads[:-1]]), pa.array(np.full(len(values), kind, np.int8)), pa.array(values, pa.binary())], names=["bin", "kind", "packed"])


def bin_of(hashes: np.ndarray, bins: int) -> np.ndarray:
    return (mix(hashes.view(np.uint64)) % np.uint64(bins)).astype(np.int64)


def cut_texts(k: int, m: int, bins: int):
    """Texts to super-k-mers, combined by chunks, one row for each bin and chunk."""

    def chunk(found: list[Strings]) -> Iterator[pa.RecordBatch]:
        kept, different, spans = combined(Strings.joined(found), k)
        many, all_spans = different > FEW, [spans]
        marked = np.unique(kept.key[many])
        few, common = kept.take(~many), kept.take(many)
        few = few.take(np.lexsort((few.start, few.row, few.doc)))
        if len(few):
            where = bin_of(few.key, bins)
            order = np.argsort(where, kind="stable")
            few, where = few.take(order), where[order]
            heads = np.append(np.flatnonzero(~like_before(where)), len(where))
            for a, b in zip(heads[:-1], heads[1:]):
                part = few.take(np.arange(a, b))
                value = packed_rows(part.runs, part.key.view(np.uint64) >> np.uint64(24), steps(part.doc), part.row, part.start)
                yield pa.RecordBatch.from_arrays([pa.array([where[a]]), pa.array([RUN], pa.int8()), pa.array([value], pa.binary())], names=["bin", "kind", "packed"])
        if len(common):
            # A bin learns that a minimiser is too common from a string of no words.
            none = np.zeros(len(marked), np.int64)
            where = bin_of(marked, bins)
            for b in np.unique(where):
                mine = marked[where == b]
                value = packed_rows(pa.array([b""] * len(mine), pa.large_binary()), mine.view(np.uint64) >> np.uint64(24), *[none[: len(mine)]] * 3)
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([RUN], pa.int8()), pa.array([value], pa.binary())], names=["bin", "kind", "packed"])
            windows, more = digested(common, k)
            all_spans.append(more)
            yield from binned(bin_of(windows[0], bins), DIGEST, list(windows), None)
        doc, row, start, end = united(*(np.concatenate(c) for c in zip(*all_spans)))
        if len(row):
            yield from binned(bin_of(row, bins)[:1].repeat(len(row)), SPAN, [doc, row, start, end], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            raw, offs = as_bytes(batch.column("text"))
            docs, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in (DOC, HASH))
            for row, base, part, at in parts_of(raw, offs, k):
                text, starts, ends, (first, count, key, digest, owner), first_of = super_kmers(part, at, k, m)
                if len(first):
                    strings = cut_out(text, starts[first], ends[first + count + k - 2])
                    found.append(Strings(key, docs[row + owner], rows[row + owner], first - first_of[owner] + base, digest, strings))
                size += len(part)
                if size >= CHUNK_BYTES:
                    if found:
                        yield from chunk(found)
                    found, size = [], 0
        if found:
            yield from chunk(found)
        tidy()

    return run


class Bin:
    """What a bin has got so far."""

    def __init__(self, k: int):
        self.k, self.held, self.size, self.hot = k, [], 0, np.zeros(0, np.int64)

    def add(self, value: bytes) -> Iterator[pa.RecordBatch]:
        (key, doc, row, start), runs = unpacked_rows(value, 4, True)
        raw, offs = as_bytes(runs.view(pa.large_string()))
        marks = np.diff(offs) == 0
        if marks.any():
            self.hot = np.union1d(self.hot, key[marks])
        found = Strings(key, sums(doc), row, start, span_hashes(prefix_hashes(raw), offs[:-1], offs[1:]).view(np.int64), runs)
        self.held.append(found.take(~marks) if marks.any() else found)
        self.size += len(raw)
        if self.size > BIN_BYTES:
            yield from self.settle(False)

    def settle(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Spans and windows of what is decided; the rest is kept unless it is the last call."""
        found = Strings.joined(self.held) if self.held else ()
        self.held, self.size = [], 0
        if not len(found):
            return
        kept, different, spans = combined(found, self.k)
        common = (different > MANY) | np.isin(kept.key, self.hot)
        every = [spans]
        if common.any():
            self.hot = np.union1d(self.hot, kept.key[common])
            (one, two, doc, row, start), more = digested(kept.take(common), self.k)
            every.append(more)
            yield from record(JUDGED, len(one), kind=DIGEST, deal=one, second=two, doc=doc, row=row, start=start)
        if last:
            several = ~common & (different > 1)
            if several.any():
                every += list(compared(kept.take(several), self.k))
        elif not common.all():
            self.held = [kept.take(~common)]
        doc, row, start, end = united(*(np.concatenate(c) for c in zip(*every)))
        yield from record(JUDGED, len(row), kind=SPAN, doc=doc, row=row, start=start, end=end)


def judge(k: int):
    """Rows sorted by bin to spans, and to windows where a minimiser is too common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = None, None
        for batch in batches:
            for which, kind, value in zip(batch.column("bin").to_pylist(), batch.column("kind").to_pylist(), batch.column("packed")):
                if which != number:
                    if now is not None:
                        yield from now.settle(True)
                    number, now = which, Bin(k)
                if kind == RUN:
                    yield from now.add(value.as_py())
                elif kind == DIGEST:
                    (one, two, doc, row, start), _ = unpacked_rows(value.as_py(), 5, False)
                    yield from record(JUDGED, len(one), kind=DIGEST, deal=one, second=two, doc=doc, row=row, start=start)
                else:
                    (doc, row, start, end), _ = unpacked_rows(value.as_py(), 4, False)
                    yield from record(JUDGED, len(row), kind=SPAN, doc=doc, row=row, start=start, end=end)
        if now is not None:
            yield from now.settle(True)
        tidy()

    return run


def judge_windows(k: int):
    """Sorted by digest and document: all windows that do not stand in the first document are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two, doc, row, start = (batch.column(c).to_numpy() for c in ("deal", "second", "doc", "row", "start"))
            heads = ~like_before(one, two)
            head = first_value(doc, heads)
            if last == (one[0], two[0]):
                head[: np.flatnonzero(heads)[1] if heads.sum() > 1 else len(head)] = first
            last, first = (one[-1], two[-1]), int(head[-1])
            later = doc > head
            d, r, a, b = united(doc[later], row[later], start[later], start[later] + k)
            yield from record(SPANS, len(r), doc=d, row=r, start=a, end=b)

    return run


# --- operator ----------------------------------------------------------------------------------------
def identified(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return documents.withColumns({DOC: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), HASH: F.xxhash64(text)})


def repeated_words(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Intervals (doc, row, start, end) of word numbers to remove, not yet united; doc and row are DOC and HASH of ``identified``."""
    if not 0 < m <= k:
        raise ValueError("0 < m <= k is required")
    n = partitions(documents.sparkSession)
    texts = identified(documents, id_col, text_col).select(DOC, HASH, F.col(text_col).cast("string").alias("text"))
    bins = texts.mapInArrow(cut_texts(k, m, BINS * n), BINNED).repartition(n, "bin").sortWithinPartitions("bin")
    judged = stored(bins.mapInArrow(judge(k), JUDGED), "super-k-mers")
    common = judged.where(F.col("kind") == DIGEST).select("deal", "second", "doc", "row", "start")
    windows = common.repartition(n, "deal").sortWithinPartitions("deal", "second", "doc").mapInArrow(judge_windows(k), SPANS)
    return judged.where(F.col("kind") == SPAN).select("doc", "row", "start", "end").unionByName(windows)


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


@F.arrow_udf(RESULT)
def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Number of words, of removed words, and the kept words joined by one blank."""
    raw, offs = as_bytes(texts)
    owner_of = np.repeat(np.arange(len(texts)), np.diff(spans.offsets.to_numpy()))
    flat = spans.flatten()
    from_word, to_word = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
    n_words, n_removed, sizes, pieces = [], [], [], []
    for a, b, part, at in slices(raw, offs):
        starts, ends, first = word_spans(part, at, SPACED)
        n, mine = len(starts), (owner_of >= a) & (owner_of < b)
        base = first[owner_of[mine] - a]
        depth = np.bincount(base + from_word[mine], minlength=n + 1) - np.bincount(base + to_word[mine], minlength=n + 1)
        kept = np.flatnonzero(np.cumsum(depth)[:n] == 0)
        owner = per_text(first, n)
        left = np.bincount(owner[kept], minlength=b - a)
        n_words.append(np.diff(first))
        n_removed.append(np.diff(first) - left)
        text, start, end = packed(part, starts[kept], ends[kept])
        size = np.bincount(owner[kept], end - start + 1, b - a).astype(np.int64)
        sizes.append(np.maximum(size - 1, 0))
        if len(text):
            solid = np.ones(len(text), bool)
            solid[np.cumsum(size[left > 0]) - 1] = False  # no blank after a text's last word
            pieces.append(text[solid])
    lengths = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
    kept_text = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int64)), pa.py_buffer(data))
    counts = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in (n_words, n_removed)]
    return pa.StructArray.from_arrays([*counts, kept_text.cast(pa.string())], names=RESULT.names)


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """``documents`` with ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one blank)."""
    plain = documents.drop(*RESULT.names, DOC, HASH)
    spans = repeated_words(plain, id_col=id_col, text_col=text_col, k=k, m=m)
    each = spans.groupBy(F.col("doc").alias(DOC), F.col("row").alias(HASH)).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    out = identified(plain, id_col, text_col).join(each, [DOC, HASH], "left").withColumn("_cut", without(F.col(text_col).cast("string"), F.col("_spans")))
    return out.withColumns({c: F.col("_cut")[c] for c in RESULT.names}).drop("_cut", "_spans", DOC, HASH)

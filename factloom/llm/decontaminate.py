"""Benchmark decontamination: normalised n-grams of test items against every training window.

Words are runs of letters, digits and everything beyond ASCII, A-Z lower-cased. A window is ``n`` consecutive words of an
item; an item of fewer words is one window. The windows of the benchmark are read in blocks of at most
``MAX_WINDOWS``: each block is one broadcast set, so its size is bounded whatever the benchmark's. Every task scans all word windows of
its texts against the set and compares the words of each hit.

Edge cases: null or empty texts have no words and no hits; an item without words is no window; repeated items are items of their own; items
with a null id are searched like others and count as hits, but are not named in ``items``; ids that are no numbers are named as strings; rows keep their null ids; other columns, whatever their names, pass through ``remove`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import ALNUM, LOWER, as_bytes, per_text, prefix_hashes, run_hashes, slices, span_hashes, word_spans

WINDOW = 13
MAX_WINDOWS = 1_000_000
NESTED = pa.list_(pa.list_(pa.int64()))


def found_type(named: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("hit_words", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(named)),
    ])


def normal_words(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM)
    low = LOWER[raw].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class WindowSet:
    """Windows of some items: by length, sorted hashes with the windows (words joined by one space) and their items."""

    def __init__(self, items: list[tuple[int | str | None, str | None]], n: int):
        owners: dict[bytes, set[int | str]] = {}
        for item, text in items:
            words = normal_words(text)
            for i in range(max(1, len(words) - n + 1) if words else 0):
                owners.setdefault(b" ".join(words[i : i + n]), set()).update(() if item is None else (item,))
        self.by_length: dict[int, tuple[np.ndarray, list[bytes], list[list[int]], np.ndarray]] = {}
        lengths: dict[int, list[bytes]] = {}
        for window in owners:
            lengths.setdefault(window.count(b" ") + 1, []).append(window)
        for k, windows in lengths.items():
            hashes = np.array([self.hash_of(w, k) for w in windows], np.uint64)
            order = np.argsort(hashes, kind="stable")
            present = np.zeros(1 << 20, bool)
            present[hashes >> np.uint64(44)] = True
            self.by_length[k] = hashes[order], [windows[i] for i in order], [sorted(owners[windows[i]]) for i in order], present

    @staticmethod
    def hash_of(window: bytes, k: int) -> int:
        raw = np.frombuffer(window, np.uint8)
        starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM)
        return int(run_hashes(span_hashes(prefix_hashes(raw, lower=True), starts, ends), k)[0])

    def scan(self, raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple]:
        """Per text: number of words, hit byte spans, hit word ranges, items with an occurring window."""
        starts, ends, first = word_spans(raw, offs, ALNUM)
        hashes = span_hashes(prefix_hashes(raw, lower=True), starts, ends)
        owner = per_text(first, len(starts))
        hits: dict[int, list[tuple[int, int, list[int]]]] = {}
        for k, (sorted_hashes, windows, owners, present) in self.by_length.items():
            runs = run_hashes(hashes, k)
            if not len(runs):
                continue
            at = np.flatnonzero(present[runs >> np.uint64(44)] & (owner[: len(runs)] == owner[k - 1 :]))
            lo = np.searchsorted(sorted_hashes, runs[at])
            keep = lo < len(sorted_hashes)
            keep[keep] = sorted_hashes[lo[keep]] == runs[at[keep]]
            for i, j in zip(at[keep].tolist(), lo[keep].tolist()):
                said = b" ".join(LOWER[raw[a:b]].tobytes() for a, b in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist()))
                while j < len(sorted_hashes) and sorted_hashes[j] == runs[i] and windows[j] != said:
                    j += 1
                if j < len(sorted_hashes) and sorted_hashes[j] == runs[i]:
                    hits.setdefault(int(owner[i]), []).append((i, i + k, owners[j]))
        for text in range(len(offs) - 1):
            n_words = int(first[text + 1] - first[text])
            ranges = merged([[a, b] for a, b, _ in hits.get(text, ())])
            base, word0 = int(offs[text]), int(first[text])
            yield (
                n_words, [[int(starts[a]) - base, int(ends[b - 1]) - base] for a, b in ranges],
                [[a - word0, b - word0] for a, b in ranges], sorted({x for h in hits.get(text, ()) for x in h[2]}),
            )


def item_type(benchmark: DataFrame, item_col: str) -> T.DataType:
    """Numbers are named as numbers, other ids as strings."""
    return T.LongType() if isinstance(benchmark.select(item_col).schema[0].dataType, (T.NumericType, T.NullType)) else T.StringType()


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, max_windows: int) -> Iterator[list[tuple[int | str | None, str | None]]]:
    """Items in blocks whose words, and so windows, stay within the bound; one item is never split.

    The rows are streamed a partition at a time; only one block is held."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast(item_type(benchmark, item_col)).alias("item"), F.col(text_col).cast("string").alias("words"))
    for row in rows.toLocalIterator():
        cost = len(row["words"] or "") // 2 + 1
        if block and size + cost > max_windows:
            yield block
            block, size = [], 0
        block.append((row["item"], row["words"]))
        size += cost
    yield block


def merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scanner(shared, named: T.DataType):
    """Column function (texts, what earlier blocks found) -> found; ``shared`` is a broadcast WindowSet."""
    kinds = (pa.int64(), NESTED, NESTED, pa.list_(pa.int64() if isinstance(named, T.LongType) else pa.string()))

    @F.arrow_udf(found_type(named))
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, before in batches:
            raw, offs = as_bytes(texts)
            rows = [r for _, _, part, at in slices(raw, offs) for r in shared.value.scan(part, at)]
            for i, old in enumerate(before.to_pylist()):
                if old is not None and old["spans"]:
                    n, spans, words, items = rows[i]
                    rows[i] = n, merged(spans + old["spans"]), merged(words + old["hit_words"]), sorted({*items, *old["items"]})
            yield pa.StructArray.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["n_words", "spans", "hit_words", "items"],
            )

    return scan


def find_windows(
    documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS, out: str = "found",
) -> DataFrame:
    """``documents`` with a struct ``out`` of ``n_words``, hit byte ``spans``, ``hit_words`` ranges and ``items`` that occur.

    One pass over the texts for each benchmark block, without a shuffle. A column that is already called ``out`` is replaced."""
    spark = documents.sparkSession
    named = item_type(benchmark, item_col)
    found = F.lit(None).cast(found_type(named))
    for items in item_blocks(benchmark, item_col, item_text_col, max_windows):
        shared = spark.sparkContext.broadcast(WindowSet(items, n))
        found = scanner(shared, named)(F.col(text_col).cast("string"), found)
    return documents.withColumn(out, found)


def n_hit(found: str = "found"):
    return F.aggregate(F.col(found)["hit_words"], F.lit(0).cast("long"), lambda total, r: total + F.get(r, 1) - F.get(r, 0))


def contaminated(found: str = "found"):
    """At least one word in twenty lies in a benchmark window."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(found)["n_words"])


def remove(found: DataFrame, *, text_col: str = "text", how: str = "documents", out: str = "found") -> DataFrame:
    """Apply what ``find_windows`` found and drop its column: 'documents' leaves out contaminated rows, 'spans' cuts hit words."""
    if how == "documents":
        return found.where(~F.coalesce(contaminated(out), F.lit(False))).drop(out)
    if how != "spans":
        raise ValueError(how)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kept = []
        for text, holes in zip(texts.to_pylist(), spans.to_pylist()):
            if not holes:
                kept.append(text)
                continue
            raw, at, parts = text.encode(), 0, []
            for a, b in holes:
                parts.append(raw[at:a])
                at = b
            kept.append(b"".join([*parts, raw[at:]]).decode())
        return pa.array(kept, pa.string())

    return found.withColumn(text_col, cut(F.col(text_col), F.col(out)["spans"])).drop(out)

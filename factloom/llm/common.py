"""Helpers of the operators: whole texts as bytes and words in numpy, and the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


# --- shared storage ------------------------------------------------------------------------
def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share, named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it gets a temporary folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage and is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """``stored`` in one bucket for each shuffle partition; ``df`` comes dealt by ``column`` in as many, and joins on it do not shuffle it again."""
    path = shared_folder(df.sparkSession, name)
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(df.sparkSession), column).saveAsTable(table)
    return df.sparkSession.table(table)


def numbered(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` with a running number of its rows, given once and stored with them.

    A number that a later job derives again may differ: splits of files follow the number of cores registered at that moment."""
    return stored(df.withColumn(column, F.monotonically_increasing_id()), name)


def tidy() -> None:
    """Give memory that past batches took back to the system; Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unsigned_crc32(column):
    """crc32 of the decimal form of an integer column, as the data splits use it."""
    return F.crc32(column.cast("string").cast("binary"))


# --- texts as bytes ------------------------------------------------------------------------
def as_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(raw: np.ndarray, offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes (one text at least): first and end row, bytes, offsets."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


# --- hashes --------------------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64)))


MULTIPLIER = 0x5851F42D4C957F2D
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """First n powers of the multiplier (or of its inverse); the longest table so far is kept."""
    if len(POWERS.get(inverse, ())) < n:
        steps = np.full(n, pow(MULTIPLIER, -1, 1 << 64) if inverse else MULTIPLIER, np.uint64)
        steps[0] = 1
        POWERS[inverse] = np.multiply.accumulate(steps)
    return POWERS[inverse][:n]


@lru_cache(maxsize=4)
def byte_codes(seed: int, lower: bool) -> np.ndarray:
    codes = stream(seed, 256)
    return codes[LOWER] if lower else codes


def room(n: int) -> int:
    """Table length for n bytes: doubling, so that few tables are made."""
    size = SLICE_BYTES * 2
    while size < n:
        size *= 2
    return size


def prefix_hashes(raw: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
    """Prefix sums H with which ``span_hashes`` gives the hash of any span of the bytes."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_codes(seed, lower)[raw] * powers(room(len(raw) + 1))[: len(raw)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal spans have equal hashes anywhere."""
    inverse = powers(room(len(prefix)), True)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


# --- words ---------------------------------------------------------------------------------
def byte_class(kind: str) -> np.ndarray:
    """Which bytes belong to words. 'spaced': all but blanks; 'alnum': digits, letters, all beyond ASCII.

    Both classes hold every byte from 0x80, so words of code points and of UTF-8 bytes agree."""
    table = np.ones(256, bool)
    if kind == "spaced":
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "alnum":
        table[:0x80] = False
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    else:
        raise ValueError(kind)
    return table


SPACED, ALNUM = byte_class("spaced"), byte_class("alnum")


def word_spans(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (n + 1 values)."""
    inside = table[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(raw))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def run_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive words (len - k + 1 values)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(stream(1000 + seed, k) | np.uint64(1)):
        out += words[j : j + n] * c
    return mix(out + np.uint64(k))


def per_text(starts_at: np.ndarray, n: int) -> np.ndarray:
    """Index of the text of each of n words, from the first word of each text."""
    return np.repeat(np.arange(len(starts_at) - 1), np.diff(starts_at)) if n else np.zeros(0, np.int64)

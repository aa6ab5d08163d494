"""Token ids in a binary file format: fixed-size id blocks, transposed into byte or bit planes, each plane compressed with zstandard.

Documents are dealt by ranges of doc_id, so shard numbers ascend with ids; each task encodes its range in order and cuts the ids into blocks. A block is one row
of a table in the shared folder: its planes, and the chunk index (the documents, or parts of them, that it holds). Spark writes the rows, so lost
executors and retried tasks leave no half-written file, and any store that Spark reaches will do. Every block can be decoded by itself.

Byte-level BPE never joins a non-blank to a blank after it, so a text is encoded in units of blanks and the word after them; the library encodes each
distinct unit of a task once. ``unit_pattern=None`` hands whole texts to the library, for tokenizers of another kind.

Edge cases: null and empty texts are just the end id; null doc_ids come first; rows that repeat a doc_id follow each other; texts longer than a block span
blocks; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import as_bytes, partitions, prefix_hashes, shared_folder, span_hashes, tidy

BLOCK_IDS = 1 << 16
MEMORY_UNITS, MEMORY_WORDS = 50_000, 1_500_000
TEXTS_AT_ONCE = 2048
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_AFTER_BLANK = r" [\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| $"
UNIT = f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+"
BLOCK = (
    "shard int, block int, n_ids int, width int, kind string, planes array<binary>, "
    "parts array<struct<doc_id: long, number: int, start: long, offset: int, n: int, first: boolean, last: boolean>>"
)
PART = "shard int, number int, block int, doc_id long, start long, n_tokens long, crc long, piece binary, whole boolean"


def to_planes(ids: np.ndarray, width: int, kind: str) -> list[bytes]:
    """Planes of unsigned ids of ``width`` bytes: one per byte, or one per bit, least significant first."""
    octets = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if kind == "byte":
        return [np.ascontiguousarray(octets[:, i]).tobytes() for i in range(width)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    if kind == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view(f"<u{width}").ravel().astype(np.uint32)


def byte_letters() -> dict[int, int]:
    """Byte to the character that stands for it in byte-level vocabularies: printable bytes themselves, the others from 256 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


class Encoder(dict):
    """Units of text to id bytes of the given width through a tokenizer file; what was encoded is remembered (and dropped when full).

    A unit of letters, with or without a blank before it, is one piece to byte-level BPE, so the library's model takes it as it is; marks after letters and a line end before a word
    are pieces of their own. Everything else goes through the whole library, as do texts that contain an added token of the file, which is one id there."""

    def __init__(self, tokenizer_file: str, unit_pattern: str | None):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.library = Tokenizer.from_file(tokenizer_file)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.added = "|".join(added) or None
        self.model = self.library.model
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        split = self.library.pre_tokenizer
        plain = isinstance(split, pre_tokenizers.ByteLevel) and not split.add_prefix_space and split.use_regex and self.library.normalizer is None
        self.units = re.compile(unit_pattern) if unit_pattern and plain else None
        self.letters = byte_letters()
        self.blank = chr(self.letters[0x20])
        self.forget()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def letter_ids(self, unit: str) -> bytes:
        if unit.isascii():
            piece = unit.replace(" ", self.blank)
        else:
            piece = unit.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        word = unit[1:] if unit[0] == " " else unit
        if word.isalpha():
            ids = self.letter_ids(unit)
        else:
            head = unit.rstrip(".,;:!?")
            if head != unit and (head[1:] if head[:1] == " " else head).isalpha():
                ids = self[head] + self[unit[len(head) :]]
            elif unit[0] == "\n" and unit[1:].isalpha():
                ids = self["\n"] + self[unit[1:]]
            else:
                ids = self.whole([unit])[0]
        self[unit] = ids
        return ids

    def spaced_ids(self, word: str) -> bytes:
        """Ids of a word with a blank before it."""
        if word.isalpha():
            return self.letter_ids(" " + word)
        head = word.rstrip(".,;:!?")
        if head != word and head.isalpha():
            return self.letter_ids(" " + head) + self[word[len(head) :]]
        line, _, after = word.partition("\n")
        if line and after and not after[0].isspace() and not line[-1].isspace():
            return self.spaced_ids(line) + self["\n"] + self[after]
        return self.whole([" " + word])[0]

    def forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, f"<u{self.width}")

    def remembered(self, words: pa.Array) -> np.ndarray:
        """Place of each distinct word in the memory, which is a few numbers a word: hash, size and ids. New words are encoded and put there."""
        raw, offs = as_bytes(words)
        hashes = span_hashes(prefix_hashes(raw), offs[:-1], offs[1:]) if len(words) else np.zeros(0, np.uint64)
        if len(self.hashes) + len(words) > MEMORY_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(words), bool)
        place = np.zeros(len(words), np.int64)
        place[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            codes = [self.spaced_ids(w) for w in words.take(pa.array(new)).to_pylist()]
            place[new] = len(self.sizes) + np.arange(len(new))
            self.sizes = np.append(self.sizes, np.array([len(c) for c in codes]) // self.width)
            self.ids = np.append(self.ids, np.frombuffer(b"".join(codes), f"<u{self.width}"))
            order = np.argsort(hashes[new])
            into = np.searchsorted(self.hashes, hashes[new][order])
            self.hashes = np.insert(self.hashes, into, hashes[new][order])
            self.slots = np.insert(self.slots, into, place[new][order])
        return place

    def encode(self, texts: pa.Array) -> list[bytes | memoryview]:
        """Id bytes of each text. Texts are cut at single blanks, the words of all of them together reduced to distinct ones, which are encoded and put back in place."""
        texts = texts.fill_null("")
        if self.units is None:
            return self.whole(texts.to_pylist())
        odd = pc.match_substring_regex(texts, BLANK_AFTER_BLANK).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        named = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        for i in np.flatnonzero(named).tolist():
            out[i] = self.whole([texts[i].as_py()])[0]
        for i in np.flatnonzero(odd & ~named).tolist():
            out[i] = b"".join(map(self.__getitem__, self.units.findall(texts[i].as_py())))
        plain = np.flatnonzero(~odd & ~named)
        if not len(plain):
            return out
        cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
        bounds = cut.offsets.to_numpy()
        words = cut.flatten().dictionary_encode()
        entry = words.indices.to_numpy().astype(np.int64)
        firsts = bounds[:-1] - bounds[0]
        first_words = words.dictionary.take(words.indices.take(pa.array(firsts))).to_pylist()
        use = np.ones(len(entry), bool)
        use[firsts] = False
        needed = np.flatnonzero(np.bincount(entry[use], minlength=len(words.dictionary)))
        place = self.remembered(words.dictionary.take(pa.array(needed)))
        codes = [self[w] if w else b"" for w in first_words]
        if len(self) > MEMORY_UNITS:
            self.clear()
        # Entries: what is remembered, then the first words, which have no blank before them.
        translate = np.zeros(len(words.dictionary), np.int64)
        translate[needed] = place
        entry = translate[entry]
        entry[firsts] = len(self.sizes) + np.arange(len(firsts))
        size = np.append(self.sizes, np.array([len(c) for c in codes], np.int64) // self.width)
        start = np.cumsum(size) - size
        ids = np.append(self.ids, np.frombuffer(b"".join(codes), f"<u{self.width}"))
        n = size[entry]
        ends = np.cumsum(n)
        data = memoryview(ids[np.repeat(start[entry] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        edges = (np.append(0, ends[bounds[1:] - bounds[0] - 1]) * self.width).tolist()
        for i, x, y in zip(plain.tolist(), edges, edges[1:]):
            out[i] = data[x:y]
        return out


@lru_cache(maxsize=1)
def encoder_of(tokenizer_file: str, unit_pattern: str | None) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(tokenizer_file, unit_pattern)


def encode_blocks(tokenizer_file: str, end_id: int, block_ids: int, kind: str, unit_pattern: str | None):
    """Texts in order to rows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, shard = encoder_of(tokenizer_file, unit_pattern), TaskContext.get().partitionId()
        width, press = encoder.width, zstandard.ZstdCompressor(level=1)
        end = end_id.to_bytes(width, "little")
        schema = pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())),
            ("parts", pa.list_(pa.struct([("doc_id", pa.int64()), ("number", pa.int32()), ("start", pa.int64()), ("offset", pa.int32()), ("n", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())]))),
        ])
        held, parts, filled, block, number, total = [], [], 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), f"<u{width}")
            row = [shard, block, filled, width, kind, [press.compress(p) for p in to_planes(ids, width, kind)], parts]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                doc_ids, texts = (batch.column(c).slice(at, TEXTS_AT_ONCE) for c in ("doc_id", "text"))
                for doc_id, data in zip(doc_ids.to_pylist(), encoder.encode(texts)):
                    data, done = bytes(data) + end, 0
                    n = len(data) // width
                    while done < n:
                        take = min(n - done, block_ids - filled)
                        held.append(data[done * width : (done + take) * width])
                        parts.append({"doc_id": doc_id, "number": number, "start": total, "offset": filled, "n": take, "first": done == 0, "last": done + take == n})
                        done, filled = done + take, filled + take
                        if filled == block_ids:
                            yield flush()
                            held, parts, filled, block = [], [], 0, block + 1
                    number, total = number + 1, total + n
        if filled:
            yield flush()
        held, parts = [], []
        tidy()

    return run


def write(
    documents: DataFrame, tokenizer_file: str, *, path: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS, kind: str = "byte",
    id_col: str = "doc_id", text_col: str = "text", unit_pattern: str | None = UNIT,
) -> str:
    """Encode and write all documents in ascending doc_id order, ``end_id`` after each; returns the folder of blocks."""
    if kind not in ("byte", "bit"):
        raise ValueError(kind)
    spark = documents.sparkSession
    path = path or shared_folder(spark, "token-blocks")
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = texts.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    blocks = ranged.select("doc_id", "text").mapInArrow(encode_blocks(tokenizer_file, end_id, block_ids, kind, unit_pattern), BLOCK)
    blocks.write.option("compression", "none").parquet(path)
    return path


def decode_block(row: dict) -> np.ndarray:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return from_planes([press.decompress(p) for p in row["planes"]], row["n_ids"], row["width"], row["kind"])


def decode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "number", "block", "doc_id", "start", "n_tokens", "crc", "piece", "whole"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            data, out = memoryview(decode_block(row).tobytes()), []
            for p in row["parts"]:
                piece, whole = data[4 * p["offset"] : 4 * (p["offset"] + p["n"])], p["first"] and p["last"]
                out.append((row["shard"], p["number"], row["block"], p["doc_id"], p["start"], p["n"], zlib.crc32(piece) if whole else None, None if whole else bytes(piece), whole))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as 32-bit little-endian).

    Blocks are decoded where they are read; only the parts of documents that cross a block's end are brought together."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    parts = blocks.mapInArrow(decode_parts, PART)
    whole = parts.where("whole").select("shard", "doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"])
    crossing = parts.where("not whole").groupBy("shard", "number").agg(
        F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), pieces.alias("pieces"),
    ).select("shard", "doc_id", "start", "n_tokens", F.crc32(F.aggregate("pieces", F.lit(b""), lambda a, b: F.concat(a, b))).alias("ids_crc32"))
    return whole.unionByName(crossing).join(base, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")

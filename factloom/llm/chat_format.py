"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Each prefix of a conversation is rendered and compared with the one before: what was added
is the turn's span. A turn's text is located by rendering it with two different one-character texts; where the outputs differ it begins.
A template that changes what it has rendered before is reported in ``rewrites`` with the number of such turns; spans then count from the common part.

Edge cases: turns are ordered by turn, role and text; null roles and texts are empty; a null conv_id is a conversation of its own; repeated rows are turns of
their own; an empty table gives an empty result; extra columns are ignored. A conversation is one output row, so it is put together in one
task; rendering all prefixes costs the square of its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
OPEN, CLOSE = "### ", "</turn>\n"
KNOWN = {"system": "System", "user": "User", "assistant": "Assistant"}
ESCAPES = {"\\": "\\\\", "#": "\\h", "</": "\\l", ": ": "\\c"}
ORIGINAL = {code[1]: plain for plain, code in ESCAPES.items()}
SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
FORMATTED = T.StructType([
    T.StructField("formatted", T.StringType()), T.StructField("turn_spans", SPANS), T.StructField("loss_spans", SPANS), T.StructField("rewrites", T.IntegerType()),
])


def escape(text: str) -> str:
    """Text without any control string. Backslash codes; undone by ``unescape``."""
    return re.sub(r"\\|#|</", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: ORIGINAL[m[1]], text, flags=re.S)


def turn_template(turns: list[Turn]) -> str:
    """``### Role: text</turn>`` per line; roles other than the known three are marked with ~."""
    return "".join(f"{OPEN}{KNOWN.get(role) or '~' + escape(role).replace(': ', ESCAPES[': '])}: {escape(text)}{CLOSE}" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """Turns of ``turn_template``'s output."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        head, _, text = part.removeprefix(OPEN).partition(": ")
        role = unescape(head[1:]) if head.startswith("~") else head.lower()
        turns.append((role, unescape(text)))
    return turns


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(template: Template, turns: list[Turn], trained: tuple[str, ...] = ("assistant",)) -> tuple[str, list[list[int]], list[list[int]], int]:
    """Final output, span of each turn, spans of the texts of trained roles, number of turns at which earlier output changed."""
    before, spans, loss, rewrites = template([]), [], [], 0
    for k, (role, text) in enumerate(turns):
        after = template(turns[: k + 1])
        start = common_prefix(before, after)
        rewrites += start < len(before)
        spans.append([start, len(after)])
        if role in trained:
            one, other = (template([*turns[:k], (role, probe)]) for probe in "ab")
            begin = common_prefix(one, other)
            loss.append([begin, len(after) - (len(one) - begin - 1)])
        before = after
    return before, spans, loss, rewrites


def conversations(rows: DataFrame, template: Template = turn_template, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text) rows to one row per conversation: conv_id, formatted, turn_spans, loss_spans, rewrites (offsets in code points)."""

    @F.arrow_udf(FORMATTED)
    def render(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [locate(template, [(t["role"] or "", t["text"] or "") for t in turns], trained) for turns in batch.to_pylist()]
            spans = pa.list_(pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), spans, spans, pa.int32()))], names=FORMATTED.names)

    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", render("turns").alias("f")).select("conv_id", "f.*")


READ = T.StructType([
    T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])


@F.arrow_udf(READ)
def read_back(formatted: pa.Array, loss_spans: pa.Array) -> pa.Array:
    """Digests of what the formatted texts and their loss masks hold, unescaped."""
    out = []
    for text, spans in zip(formatted.to_pylist(), loss_spans.to_pylist()):
        turns = parse(text)
        loss = "".join(unescape(text[a:b]) for a, b in spans)
        said = "".join(f"{role}\n{words}\n" for role, words in turns)
        out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    return pa.StructArray.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=READ.names)

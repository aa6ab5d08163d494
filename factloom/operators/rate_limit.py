"""Token bucket over an event table: which requests pass, which are shed.

The bucket is a sequential fold per caller, but what a run of events does to the level it is entered with is a function of few pieces: the level plus a number, or a number where the
bucket overflowed on the way. Events are dealt by ranges of (caller, time), so a busy caller lies in many tasks. One pass reduces
each task's share of the caller it begins with to that function, and to the level it leaves the last caller with; the functions are applied one after another (one row a
task); then all tasks replay their events at once, each from the level it is entered with. Levels are whole numbers of a unit in which a token and a microsecond's refill are whole too, so
both passes agree exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom import scope
from factloom.session import cut_lineage

# Events a task decides, about: hot callers are cut into that many.
BLOCK_EVENTS = 1_000_000


def refill(tokens: float, elapsed_us: int, rate: float, capacity: float) -> float:
    return min(capacity, tokens + elapsed_us / 1e6 * rate)


def admit(frame: pd.DataFrame, state: tuple | None, rate: float, capacity: float) -> tuple[list[bool], list[float], tuple]:
    """Decide rows in order. state: (piece, tokens, last time) left by the rows before."""
    piece, tokens, last = state or (None, capacity, 0)
    allowed, left = [], []
    for here, now in zip(frame["piece"], frame["at_us"]):
        tokens = refill(tokens, now - last, rate, capacity) if here == piece else capacity
        ok = tokens >= 1.0
        tokens -= 1.0 if ok else 0.0
        piece, last = here, now
        allowed.append(ok)
        left.append(tokens)
    return allowed, left, (piece, tokens, last)


@dataclass(frozen=True)
class Bucket:
    """A token, a microsecond's refill and the capacity in one unit."""

    token: int
    per_us: int
    full: int

    @classmethod
    def of(cls, rate: float, capacity: float) -> Bucket:
        if rate <= 0 or capacity <= 0:
            raise ValueError("rate and capacity must be positive")
        speed, size = (Fraction(x).limit_denominator(10**9) for x in (rate, capacity))
        unit = math.lcm(speed.denominator * 1_000_000, size.denominator)
        return cls(unit, int(speed * unit / 1_000_000), int(size * unit))

    def refilled(self, level: int, elapsed_us: int) -> int:
        return min(self.full, level + elapsed_us * self.per_us)

    def fold(self, level: int, last_us: int, times: list[int]) -> tuple[int, list[bool], list[int]]:
        """Level after the events, and for each whether it passed and what was left."""
        token, per_us, full, passed, left = self.token, self.per_us, self.full, [], []
        for now in times:
            level = min(full, level + (now - last_us) * per_us)
            last_us = now
            ok = level >= token
            if ok:
                level -= token
            passed.append(ok)
            left.append(level)
        return level, passed, left


@dataclass(frozen=True)
class Effect:
    """What events do to the level at their beginning: from ``starts[i]`` on it becomes ``slopes[i] * level + offsets[i]``."""

    starts: list[int]
    slopes: list[int]
    offsets: list[int]

    @classmethod
    def none(cls) -> Effect:
        return cls([0], [1], [0])

    def __call__(self, level: int) -> int:
        i = int(np.searchsorted(np.array(self.starts, object), level, side="right")) - 1
        return self.slopes[i] * level + self.offsets[i]

    def then(self, bucket: Bucket, elapsed_us: int) -> Effect:
        """One more event, that long after the one before. Neighbouring pieces that do the same are one."""
        starts, slopes, offsets, more = [], [], [], elapsed_us * bucket.per_us

        def add(start: int, slope: int, offset: int) -> None:
            if not (starts and slopes[-1] == slope and offsets[-1] == offset):
                starts.append(start)
                slopes.append(slope)
                offsets.append(offset)

        ends = [*self.starts[1:], bucket.full + 1]
        for start, end, slope, offset in zip(self.starts, ends, self.slopes, self.offsets):
            if not slope:
                level = min(bucket.full, offset + more)
                add(start, 0, level - bucket.token if level >= bucket.token else level)
                continue
            offset += more
            passes, overflows = bucket.token - offset, bucket.full - offset  # entry levels from which on
            if start < min(end, passes, overflows):
                add(start, 1, offset)
            if max(start, passes) < min(end, overflows):
                add(max(start, passes), 1, offset - bucket.token)
            if max(start, overflows) < end:
                add(max(start, overflows), 0, bucket.full - bucket.token if bucket.full >= bucket.token else bucket.full)
        return Effect(starts, slopes, offsets)


def _runs(keys: pd.Series) -> np.ndarray:
    """First rows of runs of equal keys; NULL equals NULL."""
    same = (keys.eq(keys.shift()) | (keys.isna() & keys.shift().isna())).to_numpy(dtype=bool, na_value=False)
    same[:1] = False
    return np.flatnonzero(~same)


def _same(a, b) -> bool:
    return (pd.isna(a) and pd.isna(b)) or (not pd.isna(a) and not pd.isna(b) and a == b)


def _summaries(key: str, bucket: Bucket, arrow: pa.Schema):
    """One row a task: the effect on its first caller, and the level of its last one unless that is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        effect, first_us, end_us, alone, tail, begun = Effect.none(), 0, 0, True, [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = batch.column(key).to_pandas(), batch.column("at_us").to_numpy()
            heads = np.append(_runs(keys), len(times))
            for a, b in [(heads[0], heads[1]), *([(heads[-2], heads[-1])] if len(heads) > 2 else [])]:
                if not begun:
                    first, first_us, end_us, begun = keys.iloc[a], int(times[a]), int(times[a]), True
                if alone and _same(keys.iloc[a], first):
                    for now in times[a:b].tolist():
                        effect, end_us = effect.then(bucket, now - end_us), now
                elif alone or not _same(keys.iloc[a], last):
                    alone, tail = False, [times[a:b]]
                else:
                    tail.append(times[a:b])
                last = keys.iloc[a]
        if begun:
            level, last_us = None, end_us
            if not alone:
                times = np.concatenate(tail).tolist()
                level, last_us = bucket.fold(bucket.full, times[0], times)[0], times[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (TaskContext.get().partitionId(), first_us, last_us, alone)] + [pa.array([level], pa.int64())]
                + [pa.array([x], pa.list_(pa.int64())) for x in (effect.starts, effect.slopes, effect.offsets)]
                + [pa.array([None if pd.isna(x) else x], arrow.field("first").type) for x in (first, last)],
                schema=arrow,
            )

    return run


def _entries(bucket: Bucket, summaries: list) -> dict[int, tuple[int, int]]:
    """Level and time each task's first caller is left with by the tasks before."""
    entries, before, last, last_us = {}, bucket.full, object(), 0
    for s in sorted(summaries, key=lambda s: s["part"]):
        goes_on = s["first"] == last
        if goes_on:
            entries[s["part"]] = (before, last_us)
        level = bucket.refilled(before, s["first_us"] - last_us) if goes_on else bucket.full
        before = Effect(s["starts"], s["slopes"], s["offsets"])(level) if s["alone"] else s["level"]
        last, last_us = s["last"], s["last_us"]
    return entries


def token_bucket(events: DataFrame, key: str, ts: str, tie: str, rate: float = scope.ASK_RATE, capacity: float = scope.ASK_BURST) -> DataFrame:
    """(key, tie, allowed, tokens_left) for every event; every bucket starts full. An event without a time is shed, with no level."""
    bucket, spark = Bucket.of(rate, capacity), events.sparkSession
    slim = events.select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"))
    timed = slim.filter("at_us is not null")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), timed.count() // BLOCK_EVENTS)
    order = [key, "at_us", tie]
    # Both passes must see the same tasks: a checkpoint keeps partitions and their order.
    dealt = cut_lineage(timed.repartitionByRange(tasks, *order).sortWithinPartitions(*order))
    summary = T.StructType().add("part", T.LongType()).add("first_us", T.LongType()).add("last_us", T.LongType()).add("alone", T.BooleanType()).add("level", T.LongType())
    for name in ("starts", "slopes", "offsets"):
        summary = summary.add(name, T.ArrayType(T.LongType()))
    key_type = events.schema[key].dataType
    summary = summary.add("first", key_type).add("last", key_type)
    entries = _entries(bucket, dealt.select(key, "at_us").mapInArrow(_summaries(key, bucket, to_arrow_schema(summary)), summary).collect())  # one row a task
    shared = spark.sparkContext.broadcast(entries)
    schema = T.StructType([events.schema[key], events.schema[tie]]).add("allowed", T.BooleanType()).add("tokens_left", T.DoubleType())
    arrow = to_arrow_schema(schema)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller, state, begun = None, shared.value.get(TaskContext.get().partitionId()), False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = batch.column(key).to_pandas(), batch.column("at_us").to_numpy()
            heads, passed, left = np.append(_runs(keys), len(times)), [], []
            for a, b in zip(heads[:-1], heads[1:]):
                some = times[a:b].tolist()
                goes_on = state is not None and (not begun or _same(keys.iloc[a], caller))
                level, last_us = state if goes_on else (bucket.full, some[0])
                level, ok, levels = bucket.fold(level, last_us, some)
                caller, state, begun = keys.iloc[a], (level, some[-1]), True
                passed += ok
                left += levels
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(tie), pa.array(passed), pa.array(np.array(left, np.float64) / bucket.token)], schema=arrow)

    untimed = slim.filter("at_us is null").select(key, tie, F.lit(False).alias("allowed"), F.lit(None).cast("double").alias("tokens_left"))
    return dealt.mapInArrow(replay, schema).unionByName(untimed)

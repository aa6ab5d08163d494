"""Ordered scans that survive a hot key.

A window over one key puts all of the key's rows into one task. Where a key may hold a large
share of the table, `block_scan` cuts its ordered rows into blocks, scans each block on its own,
and passes only one summary row per block along the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PLACE, _BLOCK, _CARRY = "__place", "__block", "__carry_"


@dataclass(frozen=True)
class Scan:
    """kind: position (1-based) | total (running sum) | last (latest non-null so far)
    | last_before (latest non-null on an earlier row) | max_before (largest on an earlier row)
    | next_after (first non-null on a later row)."""

    kind: str
    value: Column | None = None


def _local(scan: Scan, window) -> Column:
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    later = window.rowsBetween(1, Window.unboundedFollowing)
    return {
        "position": lambda: F.row_number().over(window).cast("bigint"),
        "total": lambda: F.sum(scan.value).over(so_far),
        "last": lambda: F.last(scan.value, ignorenulls=True).over(so_far),
        "last_before": lambda: F.last(scan.value, ignorenulls=True).over(earlier),
        "max_before": lambda: F.max(scan.value).over(earlier),
        "next_after": lambda: F.first(scan.value, ignorenulls=True).over(later),
    }[scan.kind]()


def _summary(scan: Scan, order: Column) -> Column:
    place = F.when(scan.value.isNotNull(), order) if scan.value is not None else None
    return {
        "position": lambda: F.count(F.lit(1)),
        "total": lambda: F.sum(scan.value),
        "last": lambda: F.max_by(scan.value, place),
        "last_before": lambda: F.max_by(scan.value, place),
        "max_before": lambda: F.max(scan.value),
        "next_after": lambda: F.min_by(scan.value, place),
    }[scan.kind]()


def _carry(scan: Scan, name: str, keys: list[str]) -> Column:
    along = Window.partitionBy(*[f"{_PLACE}.{k}" for k in keys]).orderBy(f"{_PLACE}.{_BLOCK}")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = along.rowsBetween(1, Window.unboundedFollowing)
    return {
        "position": lambda: F.sum(name).over(before),
        "total": lambda: F.sum(name).over(before),
        "last": lambda: F.last(name, ignorenulls=True).over(before),
        "last_before": lambda: F.last(name, ignorenulls=True).over(before),
        "max_before": lambda: F.max(name).over(before),
        "next_after": lambda: F.first(name, ignorenulls=True).over(after),
    }[scan.kind]()


def _merge(scan: Scan, name: str) -> Column:
    own, carried = F.col(name), F.col(_CARRY + name)
    if scan.kind in ("position", "total"):
        return F.when(carried.isNull(), own).when(own.isNull(), carried).otherwise(own + carried)
    if scan.kind == "max_before":
        return F.greatest(own, carried)
    return F.coalesce(own, carried)


def block_scan(
    df: DataFrame, keys: list[str], order: list[str], block: Column, **scans: Scan
) -> DataFrame:
    """Add one column per scan. `block` must not decrease along `order` within a key.

    Key and block travel as one struct: it is never NULL itself, so rows with a NULL key are
    scanned as a group of their own instead of being lost in the join."""
    tagged = df.withColumn(_PLACE, F.struct(*keys, block.alias(_BLOCK)))
    window = Window.partitionBy(_PLACE).orderBy(*order)
    local = tagged.select("*", *[_local(s, window).alias(n) for n, s in scans.items()])
    row = F.struct(*order)
    per_block = tagged.groupBy(_PLACE).agg(*[_summary(s, row).alias(n) for n, s in scans.items()])
    carried = per_block.select(_PLACE, *[_carry(s, n, keys).alias(_CARRY + n) for n, s in scans.items()])
    joined = local.join(carried, _PLACE)
    return joined.select(*df.columns, *[_merge(s, n).alias(n) for n, s in scans.items()])


def time_block(ts: str, seconds: int = 3600) -> Column:
    return F.floor(F.unix_timestamp(ts) / F.lit(seconds))


def line_block(line_no: str, size: int = 4096) -> Column:
    return F.floor(F.col(line_no) / F.lit(size))


def per_key_top(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key. Spark prunes to n per key inside every task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return per_key_top(df, keys, order, 1, "__first").drop("__first")


__all__ = ["Scan", "block_scan", "keep_first", "line_block", "per_key_top", "time_block"]

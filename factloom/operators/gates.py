"""Quality gates: every gate is a DataFrame of violations (rule, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(AssertionError):
    """Data broke a rule that later steps rely on."""


def violations(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enforce(gate: DataFrame, show: int = 8) -> None:
    """Raise when a gate reports anything; only the first few rows reach the driver."""
    rows = gate.limit(show).collect()
    if rows:
        raise GateError("; ".join(f"{r.rule} {r.key}: {r.detail}" for r in rows))


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate keys. NULLs compare equal in a grouping, as UNIQUE NULLS NOT DISTINCT asks."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    text = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return violations(dup, "duplicate key", text, F.concat(F.col("n").cast("string"), F.lit(" rows")))


def foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    known = parent.select(F.col(parent_column).alias(column))
    orphans = child.select(column).join(known, column, "left_anti").groupBy(column).count()
    return violations(orphans, "orphan", F.col(column), F.concat(F.col("count").cast("string"), F.lit(" rows")))


def counts_match(loaded: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Compare counts `n` per key between two count tables."""
    both = (
        expected.select(*keys, F.col("n").alias("want"), F.lit(0).cast("bigint").alias("have"))
        .unionByName(loaded.select(*keys, F.lit(0).cast("bigint").alias("want"), F.col("n").alias("have")))
        .groupBy(*keys)
        .agg(F.sum("want").alias("want"), F.sum("have").alias("have"))
        .filter("want <> have")
    )
    return violations(
        both,
        "count mismatch",
        F.concat_ws("/", *[F.col(k).cast("string") for k in keys]),
        F.format_string("%d loaded, expected %d", "have", "want"),
    )

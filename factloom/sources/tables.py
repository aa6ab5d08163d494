"""Stored tables: creation, idempotent append, reload, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.gates import union_all
from factloom.operators.scan import keep_first

# Key of every stored table; NULLs in the fact key compare equal.
KEYS = {
    "filings": ["accession_no"],
    "chunks": ["chunk_id"],
    "facts": ["ticker", "concept", "unit", "period_start", "period_end"],
    "questions": ["question_id"],
    "memos": ["request_id"],
}
PARTITIONS = {"chunks": ["ticker"]}


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key: insert, do nothing on conflict."""
    first = keep_first(incoming, keys, [F.col(c) for c in order])
    stored = existing.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return first.join(stored, same, "left_anti")


def create_table(spark: SparkSession, name: str, schema) -> None:
    """Create an empty parquet table unless it exists."""
    if not spark.catalog.tableExists(name):
        writer = spark.createDataFrame([], schema).write.format("parquet")
        parts = PARTITIONS.get(name.split(".")[-1])
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)


def append_new(spark: SparkSession, name: str, rows: DataFrame, order: list[str] | None = None) -> None:
    """Idempotent load: running it twice stores every key once."""
    keys = KEYS[name.split(".")[-1]]
    stored = spark.table(name)
    fresh = new_rows(rows.select(*stored.columns), stored, keys, order or keys)
    fresh.write.insertInto(name, overwrite=False)


def reload(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Replace the table's content, for when keys changed."""
    parts = PARTITIONS.get(name.split(".")[-1])
    writer = rows.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)


def count_tables(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all(
        [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    )

"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per document and summed per source (combined before the shuffle, so a hot source sends one row per task). Sources in code-point
order, null last, get the weights in turn and share all words by them; no target exceeds ``cap`` times its source, and what that leaves is shared
again by weight. In closed form: with sources ordered by size / weight, the level is the largest of (words not used up by the smaller sources' caps) / (weights
left), and a target is the smaller of cap and level times weight. A document is taken floor(rate) times and once more where its hash
falls below the fraction of the rate.

Edge cases: null and empty texts have no words; a source without words gets target 0 and none of its documents is taken; null doc_ids share one
draw, rows that repeat a doc_id too; an empty table gives an empty result; extra columns pass through, but those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
SMALL = 10_000  # sources up to which their table is sent to every task; beyond it the join shuffles


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, source_col: str, weights: tuple[int, ...], cap: int) -> DataFrame:
    """source, source_size, target: one row per source. Only this table, one row a source, passes a single task."""
    sums = sized.groupBy(F.col(source_col).alias("_source")).agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weighed = sums.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("source_size") / F.col("_weight"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    level = F.max("_level").over(everything)
    capped = weighed.withColumn("_level", left.cast("double") / share)
    return capped.select("_source", "source_size", F.least((cap * F.col("source_size")).cast("double"), level * F.col("_weight")).alias("target"))


def draw(id_column: Column, seed: int) -> Column:
    """Uniform in [0, 1) from 48 bits of the MD5 of id and seed."""
    digest = F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def plan(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED,
) -> DataFrame:
    """``documents`` with ``size``, ``source_size``, ``target`` (of the source) and ``copies`` to take."""
    sized = documents.withColumn("size", words(F.col(text_col)))
    goals = stored(targets(sized, source_col, weights, cap), "targets")
    if goals.count() <= SMALL:
        goals = F.broadcast(goals)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    extra = (draw(F.col(id_col), seed) < rate - F.floor(rate)).cast("int")
    both = sized.drop("source_size", "target", "copies").join(goals, F.col(source_col).eqNullSafe(F.col("_source"))).drop("_source")
    return both.withColumn("copies", (F.floor(rate) + extra).cast("int"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as many times as planned, in the columns of ``documents``."""
    planned = plan(documents, **options).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return planned.select(*documents.columns)

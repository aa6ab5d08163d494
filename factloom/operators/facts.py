"""Structured facts: restatements, conflicts, coverage, anchored lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions import filings as fx
from factloom.functions.numeric import annual_band
from factloom.operators.gates import violations

FACT_KEY = ["ticker", "concept", "unit", "period_start", "period_end"]


def resolve_restatements(facts: DataFrame, keys=FACT_KEY, latest=("filed_date", "accession_no")) -> DataFrame:
    """One row per economic fact: the most recently filed value, flagged when values disagreed.

    A plain aggregation (combined inside each task before the shuffle), so a fact reported a
    billion times costs no more than any other. NULL period starts group together."""
    payload = [c for c in facts.columns if c not in {*keys, "restated"}]
    winner = F.max_by(F.struct(*payload), F.struct(*latest)).alias("__w")
    restated = (F.min("value") != F.max("value")).alias("restated")
    grouped = facts.groupBy(*keys).agg(winner, restated)
    return grouped.select(*keys, *[F.col(f"__w.{c}").alias(c) for c in payload], "restated")


def conflicts(facts: DataFrame, keys=FACT_KEY, allowed=(), tolerance=scope.CONFLICT_REL_TOLERANCE) -> DataFrame:
    """Economic facts whose values differ by more than the tolerance: keys, n_values, low, high."""
    spread = (
        facts.groupBy(*keys)
        .agg(
            F.countDistinct("value").alias("n_values"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .filter("n_values > 1")
        .filter(
            F.abs(F.col("high") - F.col("low"))
            > F.lit(tolerance) * F.greatest(F.abs("high"), F.lit(1.0))
        )
    )
    if allowed:
        pair = F.concat_ws("\t", "ticker", "concept")
        spread = spread.filter(~pair.isin(*["\t".join(a) for a in allowed]))
    return spread


def conflict_gate(facts: DataFrame, allowed=scope.RESTATEMENT_ALLOWLIST) -> DataFrame:
    found = conflicts(facts, allowed=allowed)
    period = F.concat_ws("..", F.col("period_start").cast("string"), F.col("period_end").cast("string"))
    return violations(
        found, "conflicting values", F.concat_ws(" ", "ticker", "concept", period),
        F.concat_ws(" to ", F.col("low").cast("string"), F.col("high").cast("string")),
    )


def coverage_gaps(entities: DataFrame, facts: DataFrame, key: str, concept: str, wanted) -> DataFrame:
    """(entity, missing concept). The wanted list is fixed configuration, so each entity's set is
    bounded and neither a cross join nor a second pass is needed."""
    have = (
        facts.filter(F.col(concept).isin(*wanted)).groupBy(key).agg(F.collect_set(concept).alias("have"))
    )
    want = F.array(*[F.lit(w) for w in wanted])
    return (
        entities.select(key)
        .join(have, key, "left")
        .select(
            key,
            F.explode(
                F.when(F.col("have").isNull(), want).otherwise(F.array_except(want, "have"))
            ).alias("missing"),
        )
    )


def coverage_gate(tickers: DataFrame, facts: DataFrame, concepts=scope.CORE_CONCEPTS) -> DataFrame:
    gaps = coverage_gaps(tickers, facts, "ticker", "concept", concepts)
    return violations(gaps, "no facts", F.concat_ws("/", "ticker", "missing"), F.lit("concept never reported"))


def traceable_gate(facts: DataFrame, filings: DataFrame) -> DataFrame:
    known = filings.select("accession_no")
    lost = facts.join(known, "accession_no", "left_anti").groupBy("accession_no").count()
    return violations(lost, "untraceable fact", F.col("accession_no"), F.col("count"))


def anchored(facts: DataFrame, filings: DataFrame, annual: Column) -> DataFrame:
    """Facts that sit on the annual filing's own period end: one row per (ticker, concept,
    fiscal_year). Where several units or periods qualify, the latest period, then the first unit,
    then the latest filing wins."""
    anchor = filings.filter(annual).select(
        "ticker", "fiscal_year", F.col("fiscal_period").alias("period_end")
    ).distinct()
    hits = facts.filter(annual_band(F.col("period_start"), F.col("period_end"))).join(
        anchor, ["ticker", "period_end"]
    )
    rank = F.struct(
        F.negate(F.unix_date("period_end")), F.col("unit"),
        F.negate(F.unix_date("filed_date")), F.col("accession_no"), F.col("value"),
    )
    best = F.min_by(F.struct("value", "unit", "period_end", "accession_no", "restated"), rank)
    return hits.groupBy("ticker", "concept", "fiscal_year").agg(best.alias("f")).select(
        "ticker", "concept", "fiscal_year", "f.*"
    )


def lookup(requests: DataFrame, anchors: DataFrame) -> DataFrame:
    """Left join of (ticker, label or concept, fiscal_year) requests to the anchored facts."""
    return requests.join(anchors, ["ticker", "concept", "fiscal_year"], "left").withColumn(
        "found", F.col("value").isNotNull()
    )


def miss_reason(ticker: Column, concept: Column, fiscal_year: Column) -> Column:
    """Why a lookup found nothing."""
    return F.when(concept.isNull(), F.lit("no concept known for this label")).otherwise(
        F.concat(F.lit("no "), concept, F.lit(" fact for "), ticker, F.lit(" FY"), fiscal_year.cast("string"))
    )


def explain_misses(looked_up: DataFrame, facts: DataFrame) -> DataFrame:
    """Add `available_concepts` (the ticker's own concepts, bounded by the tracked list) and a
    reason to the misses."""
    have = facts.groupBy("ticker").agg(F.array_sort(F.collect_set("concept")).alias("available_concepts"))
    reason = F.when(~F.col("found"), miss_reason(F.col("ticker"), F.col("concept"), F.col("fiscal_year")))
    return looked_up.join(have, "ticker", "left").withColumn("detail", F.coalesce(reason, F.lit("")))


def enumerate_lookups(plans: DataFrame, default_years=scope.FISCAL_YEARS) -> DataFrame:
    """Unfold (request_id, tickers, fiscal_years, concepts) plans into lookup requests."""
    years = F.when(F.size("fiscal_years") > 0, F.col("fiscal_years")).otherwise(
        F.array(*[F.lit(y) for y in default_years])
    )
    return (
        plans.select("request_id", F.explode("tickers").alias("ticker"), years.alias("y"), "concepts")
        .select("request_id", "ticker", F.explode("y").alias("fiscal_year"), "concepts")
        .select("request_id", "ticker", "fiscal_year", F.explode("concepts").alias("label"))
        .withColumn("concept", fx.concept_of(F.col("ticker"), F.col("label")))
        .filter("concept is not null")
    )

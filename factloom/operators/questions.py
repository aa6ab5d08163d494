"""Numeric evaluation questions: generation, balanced selection, grading, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions import filings as fx
from factloom.functions.numeric import annual_band, exact_delta, percent_change, within
from factloom.operators.gates import union_all, violations
from factloom.operators.scan import per_key_top


def annual_facts(facts: DataFrame, years=scope.FISCAL_YEARS, strict_parity: bool = False,
                 annual_periods: DataFrame | None = None) -> DataFrame:
    """One unrestated fact per (ticker, concept, fiscal_year), the latest period winning.

    Instants must fall on an annual filing's own period end (`annual_periods`: ticker,
    period_end). With `strict_parity`, or where no periods are given, any instant of the year
    counts and the latest one wins, quarter ends included."""
    usable = facts.filter(
        ~F.col("restated")
        & annual_band(F.col("period_start"), F.col("period_end"))
        & ~fx.fiscal_year_ambiguous(F.col("period_end"))
    ).withColumn("fiscal_year", fx.fiscal_year(F.col("period_end")))
    usable = usable.filter(F.col("fiscal_year").isin(*years))
    if annual_periods is not None and not strict_parity:
        anchors = annual_periods.select("ticker", "period_end").distinct().withColumn("is_anchor", F.lit(True))
        usable = usable.join(anchors, ["ticker", "period_end"], "left").filter(
            F.col("period_start").isNotNull() | F.col("is_anchor")
        )
    rank = F.struct("period_end", "filed_date", "accession_no", "unit", "value")
    latest = F.max_by(F.struct("value", "unit", "accession_no", "period_start"), rank)
    return (
        usable.groupBy("ticker", "concept", "fiscal_year")
        .agg(latest.alias("f"))
        .select("ticker", "concept", "fiscal_year", "f.*")
    )


def paired_years(annual: DataFrame, earliest: int, latest: int) -> DataFrame:
    """Both years of a (ticker, concept) on one row, units equal. A conditional aggregation, so
    the pairing costs one shuffle instead of a self-join."""

    def pick(year: int) -> Column:
        return F.max(F.when(F.col("fiscal_year") == year, F.struct("value", "unit", "accession_no")))

    both = annual.groupBy("ticker", "concept").agg(pick(earliest).alias("prior"), pick(latest).alias("now"))
    return both.filter("prior is not null and now is not null and prior.unit = now.unit")


def _question(kind: str, text: Column, ident: Column, years: Column, expected: Column, unit: Column,
              absolute: float, sources: Column) -> list[Column]:
    return [
        ident.alias("question_id"), text.alias("question"), F.lit(kind).alias("question_type"),
        F.array("ticker").alias("tickers"), F.col("concept"), years.alias("fiscal_years"),
        expected.alias("expected_value"), F.lit(None).cast("string").alias("expected_text"),
        unit.alias("unit"), F.lit(0.0).alias("rel_tolerance"), F.lit(absolute).alias("abs_tolerance"),
        sources.alias("source_accessions"),
    ]


def build_questions(annual: DataFrame, years=scope.FISCAL_YEARS) -> DataFrame:
    """Point questions for every annual fact; change and percent questions for the year pair."""
    label = F.coalesce(fx.mapped(scope.CONCEPT_LABELS, F.col("concept")), F.col("concept"))
    ticker, year = F.col("ticker"), F.col("fiscal_year")
    when = F.when(F.col("period_start").isNotNull(), F.lit("for")).otherwise(F.lit("as of the end of"))
    points = annual.select(
        *_question(
            "point",
            F.format_string("What was %s's %s %s fiscal year %d?", ticker, label, when, year),
            F.concat_ws("-", F.lit("t1-point"), ticker, "concept", year.cast("string")),
            F.array(year), F.col("value"), F.col("unit"), 0.0, F.array("accession_no"),
        )
    )
    earliest, latest = min(years), max(years)
    if earliest == latest:
        return points
    pairs = paired_years(annual, earliest, latest)
    span = F.array(F.lit(earliest), F.lit(latest))
    sources = F.array("prior.accession_no", "now.accession_no")
    changes = pairs.select(
        *_question(
            "yoy_change",
            F.format_string(
                f"By how much did %s's %s change from fiscal year {earliest} to fiscal year {latest}? "
                "Report the absolute change.", ticker, label,
            ),
            F.concat_ws("-", F.lit("t1-chg"), ticker, "concept"),
            span, exact_delta(F.col("now.value"), F.col("prior.value")), F.col("now.unit"), 0.0, sources,
        )
    )
    percents = pairs.filter("prior.value <> 0").select(
        *_question(
            "yoy_pct",
            F.format_string(
                f"What was the percentage change in %s's %s from fiscal year {earliest} to fiscal year "
                f"{latest}? Report a percentage.", ticker, label,
            ),
            F.concat_ws("-", F.lit("t1-pct"), ticker, "concept"),
            span, percent_change(F.col("now.value"), F.col("prior.value")), F.lit("percent"),
            scope.PERCENT_ABS_TOLERANCE, sources,
        )
    )
    return union_all([points, changes, percents])


def priority(concept: Column, ordered=scope.CONCEPT_PRIORITY) -> Column:
    """Place in the priority list, 0 first; everything unlisted comes after it."""
    place = F.array_position(F.array(*[F.lit(c) for c in ordered]), concept)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(ordered)))


def select_frozen(questions: DataFrame, per_stratum: int = 3) -> DataFrame:
    """The first `per_stratum` questions per (ticker, type) by priority, then id."""
    keyed = questions.withColumn("stratum", F.get("tickers", 0))
    chosen = per_key_top(
        keyed, ["stratum", "question_type"], [priority(F.col("concept")), F.asc("question_id")], per_stratum
    )
    return chosen.drop("stratum", "rank")


def grade(answer: Column, expected_value: Column, expected_text: Column, relative: Column, absolute: Column) -> Column:
    """True when the answer matches; an unparseable number is simply wrong."""
    as_text = F.upper(F.btrim(answer)) == F.upper(expected_text)
    number = F.btrim(answer).try_cast("double")
    as_number = within(number, expected_value, relative, absolute) & ~F.isnan(number)
    return F.coalesce(F.when(expected_text.isNotNull(), as_text).otherwise(as_number), F.lit(False))


def validity_gate(questions: DataFrame, filings: DataFrame) -> DataFrame:
    ident = F.col("question_id")
    copies = questions.groupBy("question_id").count().filter("count > 1")
    known = filings.select(F.col("accession_no").alias("source"))
    uncitable = questions.select("question_id", F.explode("source_accessions").alias("source")).join(
        known, "source", "left_anti"
    ).distinct()
    own_answer = F.coalesce("expected_text", F.col("expected_value").cast("string"))
    ungraded = questions.filter(
        ~grade(own_answer, F.col("expected_value"), F.col("expected_text"), F.col("rel_tolerance"), F.col("abs_tolerance"))
    )
    not_a_number = questions.filter(F.isnan("expected_value"))
    return union_all(
        [
            violations(copies, "duplicate question", ident, F.col("count")),
            violations(uncitable, "uncitable source", ident, F.col("source")),
            violations(ungraded, "fails its own answer", ident, own_answer),
            violations(not_a_number, "not a number", ident, F.lit("NaN")),
        ]
    )


# --- labelled retrieval cases ---------------------------------------------------------------------

def round_robin(candidates: DataFrame, key: str, section: str, order: list[str], sections=scope.SECTION_ORDER, target: int = scope.TARGET_CASES) -> DataFrame:
    """`target` cases, taken one per key and round. Each key starts at a different section.

    Only the first `target` keys can be drawn from (each round visits every key), and only the
    first `target` rows of a key, so both cuts are exact and everything after them is small."""
    keys = candidates.select(key).distinct().orderBy(key).limit(target)
    places = keys.agg(F.array_sort(F.collect_list(key)).alias("keys")).select(
        F.posexplode("keys").alias("offset", key)
    )
    place = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col(section)) - 1
    rotated = candidates.join(places, key).withColumn(
        "turn", F.pmod(place - F.col("offset"), F.lit(len(sections)))
    )
    rounds = per_key_top(rotated, [key], [F.col("turn"), *[F.col(c) for c in order]], target, "round")
    drawn = rounds.orderBy("round", key).limit(target)
    packed = drawn.agg(
        F.array_sort(F.collect_list(F.struct("round", key, section, *order))).alias("drawn")
    )
    return packed.select(F.posexplode("drawn").alias("case_no", "c")).select(
        (F.col("case_no") + 1).alias("case_no"), "c.*"
    )


def case_query(section: Column, name: Column, year: Column, case_no: Column) -> Column:
    """Template text for a case; templates alternate with the case number."""
    templates = F.create_map(
        *[x for s, t in scope.QUERY_TEMPLATES.items() for x in (F.lit(s), F.array(*[F.lit(q) for q in t]))]
    )
    options = F.try_element_at(templates, section)
    chosen = F.get(options, ((case_no - 1) % F.size(options)).cast("int"))
    return F.replace(F.replace(chosen, F.lit("{ticker}"), name), F.lit("{year}"), year.cast("string"))

"""Filing index: scope, deduplication, completeness, integrity, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import scope
from factloom.functions import filings as fx
from factloom.functions.text import split_items
from factloom.operators.gates import union_all, violations
from factloom.operators.scan import keep_first


def list_filings(rows: DataFrame, years=scope.FISCAL_YEARS, forms=scope.PERIODIC_FORMS) -> DataFrame:
    """In-scope filings. Rows carry `page`, their place in the source listing; the first copy of
    an accession number wins, amendments stay but are flagged."""
    first = keep_first(rows, ["ticker", "accession_no"], [F.col("page")])
    return (
        first.filter(F.col("report_date").isNotNull())
        .withColumn("fiscal_year", fx.fiscal_year(F.col("report_date")))
        .filter(fx.base_form(F.col("form")).isin(*forms) & F.col("fiscal_year").isin(*years))
        .withColumn("is_amendment", fx.is_amendment(F.col("form")))
        .withColumn("fy_ambiguous", fx.fiscal_year_ambiguous(F.col("report_date")))
        .withColumn("items", split_items(F.col("items")))
        .drop("page")
    )


def resolve_keys(requested: DataFrame, known: DataFrame, overrides: dict[str, int]) -> DataFrame:
    """Add `cik` to (ticker, ...): the override wins over the mapped key, an unknown ticker raises."""
    mapping = known.select(F.upper("ticker").alias("__name"), F.col("cik").alias("__cik"))
    joined = requested.join(mapping, F.upper("ticker") == F.col("__name"), "left")
    override = fx.mapped(overrides, F.upper("ticker")) if overrides else F.lit(None).cast("int")
    missing = F.raise_error(F.concat(F.lit("ticker absent from the key map: "), F.col("ticker"))).cast("int")
    return joined.withColumn(
        "cik", F.coalesce(override.cast("int"), F.col("__cik").cast("int"), missing)
    ).drop("__name", "__cik")


def overlapping(files: DataFrame, start: str, end: str, low: str, high: str) -> DataFrame:
    """Files whose [start, end] touches [low, high]; bounds are literals, so the scan prunes."""
    return files.filter((F.col(end) >= F.lit(low)) & (F.col(start) <= F.lit(high)))


def period_window(years) -> tuple[str, str]:
    return f"{min(years) - 1}-01-01", f"{max(years) + 1}-12-31"


def fiscal_period_gate(filings: DataFrame, years=scope.FISCAL_YEARS) -> DataFrame:
    label = F.concat_ws(" ", "form", F.col("report_date").cast("string"))
    return union_all(
        [
            violations(
                filings.filter(~F.col("fiscal_year").isin(*years)),
                "outside fiscal years", F.col("accession_no"), label,
            ),
            violations(
                filings.filter("fy_ambiguous"), "ambiguous fiscal year", F.col("accession_no"), label
            ),
        ]
    )


def missing_years(entities: DataFrame, filings: DataFrame, key: str, years, annual: Column) -> DataFrame:
    """Per entity: years found and missing among the annual, unamended filings.

    The year set per entity is bounded by the scope, so no large set is ever collected."""
    wanted = F.array(*[F.lit(y) for y in sorted(years)])
    have = (
        filings.filter(annual & F.col("fiscal_year").isin(*years))
        .groupBy(key)
        .agg(F.collect_set("fiscal_year").alias("have"))
    )
    return (
        entities.select(key)
        .join(have, key, "left")
        .withColumn("have", F.coalesce("have", F.array().cast("array<int>")))
        .select(
            key,
            F.size("have").alias("n_found"),
            F.array_sort(F.array_except(wanted, "have")).alias("missing"),
        )
    )


def completeness_gate(entities: DataFrame, filings: DataFrame, years=scope.FISCAL_YEARS) -> DataFrame:
    annual = (F.col("form") == "10-K") & ~F.col("is_amendment")
    gaps = missing_years(entities, filings, "ticker", years, annual).filter(F.size("missing") > 0)
    return violations(
        gaps, "incomplete corpus", F.col("ticker"),
        F.concat(F.lit("missing "), F.array_join(F.transform("missing", lambda y: y.cast("string")), ",")),
    )


def integrity_gate(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """Manifest against (local_path, size_bytes, sha256) of what is stored; content never moves,
    only sizes and hashes take part in the join."""
    seen = disk.select(
        "local_path", F.col("size_bytes").alias("disk_size"), F.col("sha256").alias("disk_hash")
    )
    claims = (F.coalesce("local_path", F.lit("")) != "") | (F.coalesce("sha256", F.lit("")) != "")
    phantom = violations(
        manifest.filter(~F.col("downloaded") & claims),
        "phantom file", F.col("accession_no"), F.lit("not downloaded but claims a file"),
    )
    joined = manifest.filter("downloaded").join(seen, "local_path", "left")
    reason = (
        F.when(F.col("disk_hash").isNull(), F.lit("missing file"))
        .when(F.col("disk_size") != F.col("size_bytes"), F.lit("size differs"))
        .when(F.col("disk_hash") != F.col("sha256"), F.lit("hash differs"))
    )
    damaged = joined.withColumn("reason", reason).filter("reason is not null")
    return phantom.unionByName(
        violations(damaged, "damaged file", F.col("accession_no"), F.col("reason"))
    )


def form_histogram(filings: DataFrame) -> DataFrame:
    return filings.groupBy("form").agg(F.count(F.lit(1)).alias("n"))


def listing_report(filings: DataFrame, *keep: str) -> DataFrame:
    """One printable line per filing."""
    flags = F.concat_ws(
        " ",
        F.when(F.col("is_amendment"), F.lit("AMENDED")),
        F.when(F.col("fy_ambiguous"), F.lit("FY?")),
    )
    text = F.format_string(
        "%-7s%-8s%-13s%-7d%-13s%s",
        "ticker", "form", F.col("report_date").cast("string"), "fiscal_year",
        F.col("filing_date").cast("string"), flags,
    )
    return filings.select(*(keep or ("ticker", "report_date")), text.alias("line"))


def _entry() -> Column:
    return F.concat(F.col("accession_no"), F.lit(":"), F.col("sha256"), F.lit("\n"))


def fingerprint(manifest: DataFrame, prefix: int = 4) -> DataFrame:
    """Order-independent hash of the corpus as (scheme, fingerprint, n_files), in two levels: entries fall into 16**prefix leaves by their own hash, each leaf is hashed
    in order, and the leaf digests are hashed. Copies of an entry are counted first, so no leaf
    grows with duplication; the top level is bounded by the number of leaves."""
    held = manifest.filter("downloaded")
    counted = held.groupBy(_entry().alias("entry")).agg(F.count(F.lit(1)).alias("copies"))
    leaves = (
        counted.groupBy(F.substring(F.sha2("entry", 256), 1, prefix).alias("leaf"))
        .agg(
            F.array_sort(F.collect_list(F.concat("entry", F.col("copies").cast("string")))).alias("entries"),
            F.sum("copies").alias("files"),
        )
        .select("leaf", "files", F.sha2(F.array_join("entries", "\n"), 256).alias("digest"))
    )
    top = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("leaf", "digest"))), lambda x: x["digest"]), ""
    )
    return leaves.agg(
        F.lit("tree").alias("scheme"), F.sha2(top, 256).alias("fingerprint"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("n_files"),
    )

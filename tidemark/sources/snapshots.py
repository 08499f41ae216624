"""Snapshots and reports from JSON and Markdown files, read by Spark's file sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import as_percent, strict_number
from ..operators.contract import violations
from ..operators.evaluation import slot_of


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Each file as (path, text), whole; manifests are left out."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    name = F.col("_metadata.file_path")
    return files.select(name.alias("path"), F.col("value").alias("text")).where(~name.endswith("/manifest.json"))


def first_available(spark: SparkSession, paths: list[str], pattern: str = "*.*") -> DataFrame | None:
    """The documents below the first of several paths that there is anything at; None if there is nothing at any."""
    for path in paths:
        try:
            found = read_documents(spark, path, pattern)
        except AnalysisException:
            continue
        if not found.isEmpty():
            return found
    return None


def slots(documents: DataFrame) -> DataFrame:
    """Snapshots (path, text) by slot: how many, and how many of them keep the contract; those without a known slot are null."""
    broken = violations(documents).select("path").distinct().withColumn("broken", F.lit(True))
    doc = F.try_parse_json("text")
    raw = F.coalesce(_text(doc, "$.archive_metadata.slot"), _text(doc, "$.snapshot_slot"))
    rows = documents.select("path", slot_of(raw).alias("slot")).join(broken, "path", "left")
    return rows.groupBy("slot").agg(F.count(F.lit(1)).alias("snapshots"), F.count_if(F.col("broken").isNull()).alias("valid"))


def guarded(documents: DataFrame) -> DataFrame:
    """(path, doc, state): ok with the document as VARIANT, null for a JSON null, invalid for text that is no JSON."""
    doc = F.try_parse_json("text")
    state = F.when(doc.isNull(), "invalid").when(F.is_variant_null(doc), "null").otherwise("ok")
    return documents.select("path", doc.alias("doc"), state.alias("state"))


def _number(doc: Column, path: str) -> Column:
    return strict_number(F.try_variant_get(doc, path, "variant"))


def _text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def headers(documents: DataFrame) -> DataFrame:
    """One row for each document of either layout: slot, threshold, benchmark and its price, declared and actual stocks."""
    d = F.col("doc")
    threshold = F.coalesce(*[_number(d, p) for p in ("$.actual_threshold_pct", "$.threshold_pct", "$.archive_metadata.actual_threshold_pct", "$.archive_metadata.threshold_pct")])
    return guarded(documents).where("state = 'ok'").select(
        "path", F.coalesce(_text(d, "$.archive_metadata.snapshot_id"), _text(d, "$.snapshot_id")).alias("snapshot_id"), _text(d, "$.as_of").alias("as_of"),
        slot_of(F.coalesce(_text(d, "$.archive_metadata.slot"), _text(d, "$.snapshot_slot"))).alias("slot"), threshold.alias("threshold_pct"),
        F.nullif(F.upper(F.trim(_text(d, "$.benchmark.symbol"))), F.lit("")).alias("benchmark"), F.coalesce(_number(d, "$.benchmark.baseline"), _number(d, "$.benchmark.displayed_price")).alias("benchmark_price"),
        _number(d, "$.universe_count").alias("declared_count"), F.size(F.try_variant_get(d, "$.stocks", "array<variant>")).alias("stock_count"),
    )


def stocks(documents: DataFrame) -> DataFrame:
    """One row for each stock of each document, symbols in upper case; read ``repeated_symbols`` before evaluating."""
    s = F.col("s")
    rows = guarded(documents).where("state = 'ok'").select("path", F.posexplode(F.try_variant_get("doc", "$.stocks", "array<variant>")).alias("place", "s"))
    return rows.select(
        "path", "place", F.upper(F.trim(_text(s, "$.symbol"))).alias("symbol"), _text(s, "$.forecast").alias("forecast"), _number(s, "$.baseline").alias("baseline"),
        _number(s, "$.target_return_pct").alias("target_return_pct"), _text(s, "$.confidence").alias("confidence"), _number(s, "$.quote_freshness_seconds").alias("quote_age_seconds"),
    )


def repeated_symbols(rows: DataFrame) -> DataFrame:
    """Symbols that a document names twice, or leaves blank."""
    return rows.groupBy("path", "symbol").agg(F.count(F.lit(1)).alias("times")).where("times > 1 or symbol is null or symbol = ''")


# The names that figures of a Markdown report go by, and how far behind its name a figure may stand.
_SHARES = {
    "accuracy_pct": ("overall accuracy", "accuracy", "hit rate", "correctness"),
    "directional_accuracy_pct": ("directional accuracy", "direction accuracy"),
    "balanced_accuracy_pct": ("balanced accuracy",),
    "macro_f1_pct": ("macro[ -]?f1",),
    "coverage_pct": ("coverage",),
}
_ERRORS = {"target_mae": (r"target(?:-return)?\s+mae", r"\bmae"), "brier_score": ("brier score", "brier"), "ece": ("expected calibration error", r"\bece\b")}
_COUNTS = (r"evaluated transitions\s*/\s*symbol outcomes", "evaluated symbols")
_SHARE_REACH, _ERROR_REACH, _COUNT_REACH = 48, 32, 48


def _figure(names, reach: int, between: str, number: str) -> Column:
    """The number behind the first place where one of the names stands with no other digit between."""
    found = F.regexp_extract("text", f"(?i)(?:{'|'.join(names)})[^{between}]{{0,{reach}}}({number})", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def verification_text(reports: DataFrame) -> DataFrame:
    """Metrics of Markdown reports (path, text): percent figures after their names, errors, and counts such as '7 of 8'."""
    whole, decimal = r"\d+", r"\d+(?:\.\d+)?|\.\d+"
    out = {name: as_percent(_figure(names, _SHARE_REACH, r"\d%", decimal)) for name, names in _SHARES.items()}
    out |= {name: _figure(names, _ERROR_REACH, r"\d", decimal) for name, names in _ERRORS.items()}
    pair = lambda i: F.nullif(F.regexp_extract("text", r"(?i)(\d+)\s*(?:/|of)\s*(\d+)", i), F.lit("")).try_cast("double")
    out |= {"correct": pair(1), "evaluated": F.coalesce(pair(2), _figure(_COUNTS, _COUNT_REACH, r"\d", whole))}
    held = reports.select("path", *[c.alias(n) for n, c in out.items()])
    return held.withColumn("accuracy_pct", F.coalesce("accuracy_pct", F.try_divide(F.lit(100.0) * F.col("correct"), F.col("evaluated"))))


def verification_json(documents: DataFrame) -> DataFrame:
    """Metrics of JSON reports, by path below ``metrics`` or the root."""
    pick = lambda *names: F.coalesce(*[_number(F.col("doc"), f"{root}.{n}") for root in ("$.metrics", "$") for n in names])
    return guarded(documents).where("state = 'ok'").select(
        "path", F.coalesce(_text(F.col("doc"), "$.generated_at"), _text(F.col("doc"), "$.generatedAt"), _text(F.col("doc"), "$.as_of")).alias("generated_at"), pick("evaluated").alias("evaluated"),
        as_percent(pick("accuracy_pct", "accuracy")).alias("accuracy_pct"), as_percent(pick("coverage_pct", "coverage")).alias("coverage_pct"), pick("target_mae_pct", "target_mae").alias("target_mae"), pick("brier_score").alias("brier_score"),
    )

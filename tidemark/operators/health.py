"""Health of snapshots, verification, archive and sources: one row of facts in, coded issues and a status out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import age_seconds, parse_time, strict_number
from . import contract
from .evaluation import slot_of

FORECAST_AGE, VERIFICATION_AGE, QUOTE_AGE = 64_800, 172_800, 900
SLOTS = ("open", "break", "close")


def _issue(when: Column, level: str, code: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))


def issues(facts: DataFrame, forecast_age: int = FORECAST_AGE, verification_age: int = VERIFICATION_AGE, slots=SLOTS) -> DataFrame:
    """Rows with ``issues`` (level, code), in the order of the checks, and ``status``: error, warning or healthy.

    Facts that do not apply are null: forecast_state and verification_state (ok, missing, invalid), forecast_age_seconds,
    declared_count, stock_count, stale_quotes, missing_quote_ages, verification_age_seconds, evaluated, archive_state
    (ok, missing, not_supplied), bad_json, bad_schema, found_slots, manifest_state (ok, invalid, mismatch, no_archive) and
    unavailable_sources.
    """
    f, v, a, m = (F.col(c) for c in ("forecast_state", "verification_state", "archive_state", "manifest_state"))
    missing_slots = F.array_except(F.array(*[F.lit(s) for s in slots]), F.coalesce("found_slots", F.array().cast("array<string>")))
    checks = [
        _issue(f == "missing", "error", "FORECAST_MISSING"), _issue(f == "invalid", "error", "FORECAST_INVALID_JSON"),
        _issue((f == "ok") & F.col("forecast_age_seconds").isNull(), "error", "FORECAST_TIMESTAMP_INVALID"), _issue((f == "ok") & (F.col("forecast_age_seconds") > forecast_age), "warning", "FORECAST_STALE"),
        _issue((f == "ok") & ~F.col("declared_count").eqNullSafe(F.col("stock_count")), "error", "UNIVERSE_COUNT_MISMATCH"),
        _issue(F.col("stale_quotes") > 0, "warning", "STALE_QUOTES"), _issue(F.col("missing_quote_ages") > 0, "warning", "QUOTE_AGE_MISSING"),
        _issue(v == "missing", "warning", "VERIFICATION_MISSING"), _issue(v == "invalid", "error", "VERIFICATION_INVALID_JSON"),
        _issue((v == "ok") & ~F.coalesce(F.col("evaluated") > 0, F.lit(False)), "warning", "VERIFICATION_PENDING"), _issue((v == "ok") & (F.col("verification_age_seconds") > verification_age), "warning", "VERIFICATION_STALE"),
        _issue(a == "missing", "error", "ARCHIVE_MISSING"), _issue((a == "ok") & (F.col("bad_json") > 0), "error", "ARCHIVE_JSON_INVALID"), _issue((a == "ok") & (F.col("bad_schema") > 0), "error", "ARCHIVE_SCHEMA_INVALID"),
        _issue((a == "ok") & (F.size(missing_slots) > 0), "error", "CHECKPOINT_SLOTS_MISSING"), _issue(a == "not_supplied", "warning", "ARCHIVE_NOT_SUPPLIED"),
        _issue(m.isin("invalid", "mismatch"), "error", "ARCHIVE_MANIFEST_INVALID"), _issue(m == "no_archive", "error", "ARCHIVE_DIR_REQUIRED"),
        _issue(F.col("unavailable_sources") > 0, "warning", "RESEARCH_SOURCE_UNAVAILABLE"),
    ]
    held = facts.withColumn("issues", F.array_compact(F.array(*checks)))
    status = F.when(F.exists("issues", lambda i: i["level"] == "error"), "error").when(F.size("issues") > 0, "warning").otherwise("healthy")
    return held.withColumns({"status": status, "missing_slots": missing_slots})


def _documents(rows: DataFrame | None, name: str) -> DataFrame | None:
    """One document per site: its state (ok, invalid) and VARIANT."""
    if rows is None:
        return None
    doc = F.try_parse_json("text")
    return rows.select("site", doc.alias(name), F.when(doc.isNull(), "invalid").otherwise("ok").alias(f"{name}_state"))


def _number(doc: Column, path: str) -> Column:
    return strict_number(F.try_variant_get(doc, path, "variant"))


def _age(doc: Column, now: Column, *paths: str) -> Column:
    return age_seconds(parse_time(F.coalesce(*[F.try_variant_get(doc, p, "string") for p in paths])), now)


def facts(sites: DataFrame, now: Column, forecasts: DataFrame, verifications: DataFrame, archive: DataFrame | None = None, manifests: DataFrame | None = None, sources: DataFrame | None = None, quote_age: int = QUOTE_AGE) -> DataFrame:
    """What ``issues`` asks about each of ``sites`` (site), derived from documents (site, text).

    forecasts and verifications: one document per site, or none. archive: any number of checkpoints per site, checked by
    the contract; the slots of sound ones count. manifests: (site, state ok or mismatch). sources: (site, available).
    Without an archive, archive_state is not_supplied.
    """
    f, v = _documents(forecasts, "forecast"), _documents(verifications, "verification")
    out = sites.select("site").join(f, "site", "left").join(v, "site", "left")
    doc, report = F.col("forecast"), F.col("verification")
    stocks = F.coalesce(F.try_variant_get(doc, "$.stocks", "array<variant>"), F.array().cast("array<variant>"))
    ages = F.filter(F.transform(stocks, lambda s: _number(s, "$.quote_freshness_seconds")), lambda a: a >= 0)
    declared = F.try_variant_get(doc, "$.universe_count", "variant")
    whole = F.when(F.schema_of_variant(declared).rlike("^(BIGINT|INT|SMALLINT|TINYINT)$"), F.try_variant_get(declared, "$", "bigint"))
    out = out.select(
        "site", F.coalesce("forecast_state", F.lit("missing")).alias("forecast_state"), _age(doc, now, "$.as_of").alias("forecast_age_seconds"),
        whole.alias("declared_count"), F.size(stocks).cast("bigint").alias("stock_count"),
        F.size(F.filter(ages, lambda a: a > quote_age)).alias("stale_quotes"), (F.size(stocks) - F.size(ages)).alias("missing_quote_ages"),
        F.coalesce("verification_state", F.lit("missing")).alias("verification_state"), F.coalesce(_number(report, "$.metrics.evaluated"), _number(report, "$.evaluated")).alias("evaluated"),
        _age(report, now, "$.generated_at", "$.generatedAt", "$.as_of").alias("verification_age_seconds"),
    )
    none = F.lit(0).cast("bigint")
    if archive is None:
        out = out.withColumns({"archive_state": F.lit("not_supplied"), "bad_json": none, "bad_schema": none, "found_slots": F.array().cast("array<string>")})
    else:
        out = out.join(_archive(archive), "site", "left")
        state = F.when(F.col("checkpoints").isNull(), "missing").otherwise("ok")
        out = out.withColumns({"archive_state": state, "bad_json": F.coalesce("bad_json", none), "bad_schema": F.coalesce("bad_schema", none)}).drop("checkpoints")
    listed = manifests.select("site", F.when(F.lit(archive is None), "no_archive").otherwise(F.col("state")).alias("manifest_state")) if manifests is not None else None
    out = out.join(listed, "site", "left") if listed is not None else out.withColumn("manifest_state", F.lit(None).cast("string"))
    if sources is None:
        return out.withColumn("unavailable_sources", none)
    down = sources.groupBy("site").agg(F.count_if(~F.col("available")).alias("unavailable_sources"))
    return out.join(down, "site", "left").withColumn("unavailable_sources", F.coalesce("unavailable_sources", none))


def _archive(archive: DataFrame) -> DataFrame:
    """Of each site's checkpoints: how many, those that are no JSON or break the contract, and the slots of sound ones."""
    named = archive.select("site", "text", F.struct("site", F.xxhash64("text").alias("h")).alias("path"))
    broken = contract.violations(named.select("path", "text").distinct()).select("path").distinct().withColumn("broken", F.lit(True))
    doc = F.try_parse_json("text")
    rows = named.join(broken, "path", "left").select("site", doc.isNull().alias("bad"), F.coalesce("broken", F.lit(False)).alias("broken"), slot_of(F.try_variant_get(doc, "$.archive_metadata.slot", "string")).alias("slot"))
    sound = ~F.col("bad") & ~F.col("broken")
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("checkpoints"), F.count_if("bad").alias("bad_json"), F.count_if(~F.col("bad") & F.col("broken")).alias("bad_schema"),
        F.sort_array(F.collect_set(F.when(sound, F.col("slot")))).alias("found_slots"),
    )

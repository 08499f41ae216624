"""When a forecast must not be acted on: ordered gates over its inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import CLASSES, finite, ordered_codes, ratio, round6, unit_number, valid_probabilities

# Reason codes of the policy, in the order of its gates.
FLAGS = (("missing", "missing_data"), ("stale", "stale_data"), ("invalid", "invalid_data"), ("partial", "partial_data"), ("thin_liquidity", "inadequate_liquidity"), ("suspension_warning", "suspension"), ("limit_move_warning", "limit_move"), ("corporate_action_warning", "corporate_action"))
SWITCHES = ("suspension", "limit_move", "corporate_action")


def context_coverage(context: Column) -> tuple[Column, Column]:
    """(share of contexts that are available, whether the map can be used) of a map from name to boolean."""
    given = F.map_values(context)
    usable = F.coalesce((F.size(given) > 0) & ~F.exists(given, lambda v: v.isNull()), F.lit(False))
    share = ratio(F.size(F.filter(given, lambda v: v)), F.size(given))
    return F.when(usable, share).otherwise(0.0), usable


def resolve_probabilities(row: dict[str, list[Column]]) -> list[Column]:
    """For each class the one alias that is given; null if none or several are."""
    out = []
    for c in CLASSES:
        given = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in row[c][1:]), F.when(row[c][0].isNotNull(), 1).otherwise(0))
        out.append(F.when(given == 1, F.coalesce(*row[c])))
    return out


def decide(rows: DataFrame, min_history: int = 20, min_liquidity: float = 1.0, conflict: float = 0.5) -> DataFrame:
    """Rows with decision, reason_codes (in gate order, each once), coverage and the inputs as an audit struct.

    Takes forecast_direction, confidence, p_up, p_flat, p_down (all null: not given, which is allowed), data_quality
    (struct of status and flags), required_context (map), liquidity, suspension, limit_move, corporate_action,
    history_count, signal_conflict. A conflict must be strictly above its threshold to count.
    """
    if min_history < 0 or min_liquidity < 0 or not 0 <= conflict <= 1:
        raise ValueError("thresholds of the policy are out of range")
    no = lambda c: F.coalesce(c, F.lit(False))
    d, q = F.col("forecast_direction"), F.col("data_quality")
    confidence, liquidity, conflict_value = F.col("confidence"), F.col("liquidity"), F.col("signal_conflict")
    p = [F.col(c) for c in ("p_up", "p_flat", "p_down")]
    p_given = p[0].isNotNull() | p[1].isNotNull() | p[2].isNotNull()
    status = q["status"]
    share, usable = context_coverage(F.col("required_context"))
    amount = finite(liquidity)
    rules = [
        (d.isNull(), "missing_forecast_direction"), (no(~d.isin(*CLASSES)), "invalid_forecast_direction"),
        (confidence.isNull(), "missing_confidence"), (confidence.isNotNull() & unit_number(confidence).isNull(), "invalid_confidence"),
        (p_given & ~valid_probabilities(*p), "invalid_probabilities"),
        (q.isNull(), "missing_data_quality"), (q.isNotNull() & status.isNull(), "missing_data_quality_status"), (no(~status.isin("ok", "partial", "unavailable")), "invalid_data_quality"),
        (no(status == "unavailable"), "unavailable_data"), (no(status == "partial"), "partial_data"),
        *[(no(q[flag]), code) for flag, code in FLAGS],
        (F.col("required_context").isNull(), "missing_required_context"), (F.col("required_context").isNotNull() & ~usable, "invalid_required_context"), (usable & (share < 1), "required_context_unavailable"),
        (liquidity.isNull(), "missing_liquidity"), (liquidity.isNotNull() & (amount.isNull() | (amount < 0)), "invalid_liquidity"), (no((amount >= 0) & (amount < min_liquidity)), "inadequate_liquidity"),
        (F.col("history_count").isNull(), "missing_history"), (no(F.col("history_count") < 0), "invalid_history"), (no(F.col("history_count").between(0, min_history - 1)), "inadequate_history"),
        *[x for s in SWITCHES for x in ((F.col(s).isNull(), f"missing_{s}_flag"), (no(F.col(s)), s))],
        (conflict_value.isNull(), "missing_signal_conflict"), (conflict_value.isNotNull() & unit_number(conflict_value).isNull(), "invalid_signal_conflict"), (no(unit_number(conflict_value) > conflict), "signal_conflict"),
    ]
    codes = ordered_codes(*rules)
    names = ["forecast_direction", "confidence", "p_up", "p_flat", "p_down", "data_quality", "required_context", "liquidity", *SWITCHES, "history_count", "signal_conflict"]
    held = rows.withColumns({"reason_codes": codes, "coverage": round6(share), "audit_inputs": F.struct(*names)})
    clear = F.size("reason_codes") == 0
    return held.withColumns({"decision": F.when(clear, d).otherwise("ABSTAIN"), "status": F.when(clear, "actionable").otherwise("insufficient_data")})

"""Numbers, times and classes with one rule throughout: what is not valid becomes null, never a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("UP", "FLAT", "DOWN")
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"
_OFFSET = r"(?i)^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})\s*$"


def finite(value: Column) -> Column:
    """A double, or null where it is NaN or infinite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def given(value: Column) -> Column:
    """A double as it is: SQL's rule, by which only null is missing."""
    return value.cast("double")


def lenient_number(text: Column) -> Column:
    """A double from a string that is a plain decimal number; 'nan', 'inf', '12d' and booleans are null."""
    t = text.cast("string")
    return F.when(t.rlike(_NUMBER), finite(F.regexp_replace(F.trim(t), "_", "").try_cast("double")))


def strict_number(value: Column) -> Column:
    """A double from a VARIANT that holds a number; strings and booleans are null."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), finite(F.try_variant_get(value, "$", "double")))


def unit_number(value: Column) -> Column:
    v = finite(value)
    return F.when(v.between(0, 1), v)


def first_given(*columns: Column) -> Column:
    """The first alias that is given, before any parsing: an alias that can't be parsed does not fall through."""
    return F.coalesce(*columns)


def parse_time(text: Column) -> Column:
    """TIMESTAMP from ISO-8601 with an offset, or Unix seconds, or milliseconds from 1e11 on; anything else is null."""
    t = F.trim(text.cast("string"))
    number = lenient_number(t)
    unix = F.when(F.abs(number) >= 1e11, number / 1000).otherwise(number)
    in_range = F.abs(unix) <= 253402300799.0
    return F.when(t.rlike(_OFFSET), F.try_to_timestamp(F.upper(t))).when(in_range, F.timestamp_micros((unix * 1e6).cast("bigint")))


def iso_second(time: Column) -> Column:
    """ISO text in UTC at whole seconds, fractions cut."""
    return F.date_format(F.date_trunc("second", time), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def seconds_between(early: Column, late: Column) -> Column:
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / F.lit(1e6)


def age_seconds(time: Column, as_of: Column) -> Column:
    """Seconds from ``time`` to ``as_of``; a time ahead has age 0, a missing one none."""
    age = seconds_between(time, as_of)
    return F.when(age.isNotNull(), F.greatest(F.lit(0.0), age))


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def quotient(a: Column, b: Column) -> Column:
    """a / b as SQL has it on doubles: by 0 it is infinite, or NaN where a is 0 too."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(ratio(a, b))


def rounded_to(value: Column | str, places: int) -> Column:
    """A double to so many places as SQL rounds it: the scaled double, halves away from 0; decimal digits may tell another half."""
    value, scale = F.col(value) if isinstance(value, str) else value, F.lit(10.0**places)
    scaled = F.round(value * scale, 0) / scale
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(value)


def round6(value: Column | str) -> Column:
    return rounded_to(value, 6)


def percent(part: Column, whole: Column) -> Column:
    return round6(F.lit(100.0).cast("double") * ratio(part, whole))


def as_percent(value: Column) -> Column:
    """Shares up to 1 in size become percent; larger values are percent already."""
    return F.when(F.abs(value) <= 1, value * 100).otherwise(value)


def classify(value: Column, threshold: Column | float) -> Column:
    """UP above the threshold, DOWN below its negative, FLAT between, both ends included; null stays null."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(value > limit, "UP").when(value < -limit, "DOWN").when(value.isNotNull() & limit.isNotNull(), "FLAT")


def sign(value: Column, inverse: bool = False) -> Column:
    s = F.signum(value).cast("int")
    return -s if inverse else s


def likeliest(up: Column, flat: Column, down: Column) -> Column:
    """The class of the largest value; ties go to UP, then FLAT."""
    return F.when((up >= flat) & (up >= down), "UP").when(flat >= down, "FLAT").otherwise("DOWN")


def valid_probabilities(up: Column, flat: Column, down: Column) -> Column:
    """True where all three lie in [0, 1] and sum to 1 within 1e-9."""
    inside = unit_number(up).isNotNull() & unit_number(flat).isNotNull() & unit_number(down).isNotNull()
    return F.coalesce(inside & (F.abs(up + flat + down - 1) <= 1e-9), F.lit(False))


def clip(p: Column, least: float = 1e-12) -> Column:
    return F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))


def logit(p: Column) -> Column:
    q = clip(p)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    """Stable for large values of either sign."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softmax(*logits: Column) -> list[Column]:
    top = F.greatest(*logits)
    weights = [F.exp(x - top) for x in logits]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def ordered_codes(*rules: tuple[Column, str]) -> Column:
    """The codes of the rules that hold, in the order given, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(rule, F.lit(code)) for rule, code in rules])))


def positive_windows(values, name: str) -> list[int]:
    """Distinct positive whole numbers, or an error."""
    found = list(values)
    if not found or len(set(found)) != len(found) or any(isinstance(v, bool) or not isinstance(v, int) or v <= 0 for v in found):
        raise ValueError(f"{name} must be distinct positive whole numbers")
    return found

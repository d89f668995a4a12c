"""Scalar expressions shared by the operators, all of them plain Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that count as null when a field is coerced.
NULL_TOKENS = ("", "null", "None", "none")
#: Confidence of each calibration tier.
TIER_WEIGHTS = {0: 0.0, 1: 1.0, 2: 0.8, 3: 0.5, 4: 0.2}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Limit to [low, high]; null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def present(c: Column | str) -> Column:
    """Whether a value is truthy: neither null, zero nor the empty string."""
    text = col(c).cast("string")
    return F.coalesce((text != "") & (text != "0") & (text != "0.0") & (text != "false"), F.lit(False))


def first_present(*columns: Column | str) -> Column:
    """The first value that is neither null nor the empty string."""
    return F.coalesce(*(F.when(col(c).cast("string") != "", col(c)) for c in columns))


def reasons(*rules: tuple[str | Column, Column]) -> Column:
    """Array of the reasons whose condition holds, in the order given."""
    cases = [F.when(F.coalesce(when, F.lit(False)), F.lit(name) if isinstance(name, str) else name) for name, when in rules]
    return F.array_compact(F.array(*cases))


def sorted_set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(array)))


def severity(score: Column | str) -> Column:
    x = col(score)
    return F.when(x.isNull(), "unknown").when(x < 0.1, "pass").when(x < 0.3, "mild").when(x <= 0.7, "moderate").otherwise("severe")


def stability_severity(score: Column | str) -> Column:
    x = col(score)
    return F.when(x.isNull(), "unknown").when(x < 0.1, "pass").when(x <= 0.2, "mild").when(x <= 0.5, "moderate").otherwise("severe")


def tier_weight(tier: Column | str) -> Column:
    out = F.lit(0.0)
    for value, weight in TIER_WEIGHTS.items():
        out = F.when(col(tier) == value, F.lit(weight)).otherwise(out)
    return out


def pass_label(score: Column | str) -> Column:
    x = col(score)
    return F.when(x.isNull(), "unknown").when(x < 0.1, "pass").otherwise("fail")


def mean_present(columns: Iterable[Column | str]) -> Column:
    """Mean of the values that are not null; null if there are none."""
    columns = [col(c) for c in columns]
    total, count = F.lit(0.0), F.lit(0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0.0))
        count = count + c.isNotNull().cast("int")
    return F.when(count > 0, total / count)


def finite(x: Column | str) -> Column:
    """The number, or null for NaN and the infinities."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def python_round(x: Column | str, digits: int = 6) -> Column:
    """``round(x, digits)`` of Python: the exact binary value to the nearest decimal, ties to even.

    x * 10**digits is taken exactly, as a double and its rounding error (the
    halves of x times the scale), so that only a true tie counts as one. NaN,
    the infinities and numbers without such digits stay as they are.
    """
    x, scale = col(x).cast("double"), float(10**digits)
    halves = lambda v: (v * 134217729.0) - ((v * 134217729.0) - v)  # noqa: E731 - the upper 26 bits of a double
    high = halves(x)
    low = x - high
    s_high = (scale * 134217729.0) - ((scale * 134217729.0) - scale)
    s_low = scale - s_high
    product = x * scale
    error = ((high * s_high - product) + high * s_low + low * s_high) + low * s_low
    near = F.rint(product)
    off = product - near
    # rint() has taken a seeming tie to the even side; the error says which side is right.
    whole = (
        F.when((off == 0.5) & (error > 0), near + 1)
        .when((off == -0.5) & (error < 0), near - 1)
        .when((off == 0) & (F.abs(error) == 0.5) & (near % 2 != 0), near + F.signum(error))
        .otherwise(near)
    )
    return F.when(F.abs(x) < float(1 << 53) / scale, whole / scale).otherwise(x)


def fast_round(x: Column | str, digits: int) -> Column:
    """``F.round(x, digits)`` of a double, whose decimal arithmetic is left to the few numbers that need it.

    A product below 1e12 is less than 1e-4 off, so unless it lies that near to
    a tie its whole number is certain, and the quotient is the nearest double.
    """
    x, scale = col(x), float(10**digits)
    product = x * scale
    whole = F.floor(product + 0.5)
    sure = (F.abs(product) < 1e12) & (F.abs(product + 0.5 - F.rint(product + 0.5)) > 1e-3)
    return F.when(sure, whole / scale).otherwise(F.round(x, digits))


# --- Coercion of text fields: five dialects, one helper each -----------------


def nullable(text: Column | str) -> Column:
    """Null for the null tokens."""
    return F.when(~col(text).isin(*NULL_TOKENS), col(text))


def to_int(text: Column | str) -> Column:
    """``"221.0"`` and ``"221.7"`` are 221; null for null tokens and garbage."""
    return nullable(text).try_cast("double").cast("bigint")


def bool_c1(text: Column | str) -> Column:
    """Dialect 1: any non-empty text is true, so is ``"false"``."""
    return F.when(col(text).isNotNull(), col(text) != "")


def bool_c2(text: Column | str) -> Column:
    """Dialect 2: known words; any other text is true."""
    x = F.lower(F.trim(nullable(text)))
    return F.when(x.isin("true", "yes", "1", "stable"), True).when(x.isin("false", "no", "0", "unstable"), False).when(x.isNotNull(), True)


def bool_c3(text: Column | str) -> Column:
    """Dialect 3: known words; any other text is null, ``"2"`` too."""
    x = F.lower(F.trim(nullable(text)))
    return F.when(x.isin("true", "yes", "1", "stable", "pass", "passed"), True).when(x.isin("false", "no", "0", "unstable", "fail", "failed"), False)


def bool_c4(text: Column | str) -> Column:
    """Dialect 4: a short list of words; anything else is null."""
    x = F.lower(F.trim(nullable(text)))
    return F.when(x.isin("true", "1", "yes"), True).when(x.isin("false", "0", "no"), False)


def double_strict(text: Column | str) -> Column:
    """Dialects 1 and 2: garbage raises."""
    x = nullable(text)
    bad = F.raise_error(F.concat(F.lit("not a number: "), x)).cast("double")
    return F.when(x.isNotNull(), F.coalesce(x.try_cast("double"), bad))


def double_lenient(text: Column | str) -> Column:
    """Dialect 3: garbage is null."""
    return nullable(text).try_cast("double")


def double_finite(text: Column | str) -> Column:
    """Dialects 4 and 5: garbage, NaN and the infinities are null."""
    return finite(double_lenient(text))

"""Rates, intervals and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def wilson(successes: Column, n: Column, z: float = Z) -> Column:
    """(low, high) of the score interval; (0, 1) where nothing was tried."""
    n = n.cast("double")
    s = F.least(F.greatest(successes.cast("double"), F.lit(0.0)), n)
    usable = (n > 0) & ~F.isnan(n) & (n < F.lit(float("inf")))
    m = F.when(usable, n).otherwise(F.lit(1.0))
    p = s / m
    wide = 1 + z * z / m
    middle = (p + z * z / (2 * m)) / wide
    half = z * F.sqrt(F.greatest(p * (1 - p) / m + z * z / (4 * m * m), F.lit(0.0))) / wide
    low = F.when(usable, F.greatest(middle - half, F.lit(0.0))).otherwise(F.lit(0.0))
    high = F.when(usable, F.least(middle + half, F.lit(1.0))).otherwise(F.lit(1.0))
    return F.struct(low.alias("low"), high.alias("high"))


def sql_wilson(s: str, n: str, z: float = Z) -> tuple[str, str]:
    middle, half = f"(({s}) / ({n}) + {z * z} / (2 * ({n})))", f"{z} * sqrt(({s}) / ({n}) * (1 - ({s}) / ({n})) / ({n}) + {z * z} / (4 * ({n}) * ({n})))"
    wide = f"(1 + {z * z} / ({n}))"
    return f"greatest(0.0, ({middle} - {half}) / {wide})", f"least(1.0, ({middle} + {half}) / {wide})"


def entropy(p: Column) -> Column:
    """Bits of a coin; 0 at its ends."""
    inner = (p > 0) & (p < 1)
    q = F.when(inner, p).otherwise(F.lit(0.5))
    return F.when(inner, -(q * F.log2(q) + (1 - q) * F.log2(1 - q))).otherwise(F.lit(0.0))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded with halves toward plus infinity."""
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + F.lit(0.5)).cast("string"), F.lit("%"))


def rate_with_interval(p: Column, low: Column, high: Column) -> Column:
    """'33% (CI 12%\u201361%)' with what is known; a dash without a rate."""
    both = low.isNotNull() & high.isNotNull()
    return F.when(p.isNull(), "\u2014").when(both, F.concat(percent(p), F.lit(" (CI "), percent(low), F.lit("\u2013"), percent(high), F.lit(")"))).otherwise(percent(p))


def score_text(cited: Column, total: Column) -> Column:
    return F.concat_ws(" / ", cited.cast("string"), total.cast("string"))


def finite(x: Column) -> Column:
    """A number, or null for text that is none, NaN and the infinities."""
    v = F.try_cast(x, "double") if hasattr(F, "try_cast") else x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def ci_weight(width: Column) -> Column:
    """Narrow intervals weigh more; unknown widths weigh 1."""
    return F.when(width.isNull() | (width <= 0), F.lit(1.0)).otherwise(1 / (1 + width))

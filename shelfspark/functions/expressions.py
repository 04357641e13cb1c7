"""Column expressions of the metrics. Each division says what a zero denominator gives."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x: Col) -> Column:
    return c(x).cast("double")


def ratio(numerator: Col, denominator: Col, at_zero: float | None) -> Column:
    """numerator / denominator; ``at_zero`` where the denominator is 0 (None: null). A null stays null."""
    return F.when(c(denominator) == 0, F.lit(at_zero).cast("double")).otherwise(dbl(numerator) / F.nullif(dbl(denominator), F.lit(0.0)))


def fill_ratio(fulfilled: Col, demanded: Col) -> Column:
    """Share of demand served; 1 where there is no demand."""
    return ratio(fulfilled, demanded, 1.0)


def loss_ratio(lost: Col, demanded: Col) -> Column:
    """Share of demand lost; 0 where there is no demand."""
    return ratio(lost, demanded, 0.0)


def safe_divide(numerator: Col, denominator: Col) -> Column:
    """0 where the denominator is 0 or anything is null."""
    return F.coalesce(ratio(numerator, denominator, 0.0), F.lit(0.0))


def finite(x: Col, otherwise: float = 0.0) -> Column:
    """x where it is a finite number; ``otherwise`` for nulls, NaN and both infinities."""
    x = dbl(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(otherwise)).otherwise(x)


def share(part: Col, whole: Col) -> Column:
    """Null where the whole is 0."""
    return ratio(part, whole, None)


def floored_share(part: Col, whole: Col, floor: float = 1.0) -> Column:
    return dbl(part) / F.greatest(dbl(whole), F.lit(floor))


def clip(x: Col, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; a null stays null. x stands in the result twice only, so that nested bounds stay small."""
    out = x = c(x)
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(x.isNotNull(), out)


def unit(x: Col) -> Column:
    return clip(x, 0.0, 1.0)


def weighted(*terms: tuple[float, Column]) -> Column:
    """Sum of weight times expression, in the order given."""
    return reduce(lambda a, b: a + b, [F.lit(w) * x for w, x in terms])


def linear_score(value: Col, good: float, bad: float) -> Column:
    """0 at ``good`` or better, 100 at ``bad`` or worse, straight between."""
    if bad <= good:
        raise ValueError("bad must lie above good")
    return clip((c(value) - F.lit(good)) / F.lit(bad - good) * F.lit(100.0), 0.0, 100.0)


def log_share_score(value: Col, low: float, high: float) -> Column:
    """0 at ``low`` or less, 100 at ``high`` or more, straight in the logarithm between."""
    if low <= 0 or high <= low:
        raise ValueError("bounds must satisfy 0 < low < high")
    tiny = 1e-12
    log = lambda x: F.log(x + F.lit(tiny))
    start, end = log(F.lit(low)), log(F.lit(high))
    return clip((log(clip(value, 0.0)) - start) / (end - start) * F.lit(100.0), 0.0, 100.0)


def range_norm(value: Col, low: float, high: float) -> Column:
    """Place of a value in a fixed range, 0 to 1; 0 for an empty range."""
    return unit((c(value) - F.lit(low)) / F.lit(high - low)) if high > low else F.lit(0.0)


def scaled(value: Col, low: Col, high: Col, top: float, constant: float) -> Column:
    """Place between two bounds times ``top``; ``constant`` where the bounds are equal."""
    return F.when(c(low) == c(high), F.lit(constant)).otherwise((c(value) - c(low)) / F.nullif(c(high) - c(low), F.lit(0.0)) * F.lit(top))


#: Upper bounds of the risk tiers, each included.
TIERS = ((35.0, "Low"), (55.0, "Medium"), (75.0, "High"), (1000.0, "Critical"))


def risk_tier(score: Col) -> Column:
    """Tier of a score of -0.001 (excluded) to 1000; "nan" for other values and nulls."""
    score = c(score)
    out = F.when(score.isNull() | F.isnan(score) | (score <= -0.001), F.lit("nan"))
    for bound, name in TIERS:
        out = out.when(score <= bound, F.lit(name))
    return out.otherwise(F.lit("nan"))


def legacy_class(score: Col) -> Column:
    """Class of the older composite: 50, 35 and 20 belong to the higher class."""
    score = c(score)
    return F.when(score >= 50, "Critical").when(score >= 35, "High").when(score >= 20, "Medium").otherwise("Low")


def argmax(columns: Sequence[tuple[str, str]]) -> Column:
    """Label of the largest of some columns, (column, label); the first of equals."""
    top = F.greatest(*[c(name) for name, _ in columns])
    return F.coalesce(*[F.when(c(name) == top, F.lit(label)) for name, label in columns])


def dos_cap(abc: Col = "abc_class") -> Column:
    """Days of supply that policy allows: A 20, B 30, else (and unknown) 45."""
    return F.when(c(abc) == "A", 20.0).when(c(abc) == "B", 30.0).otherwise(45.0)


def slow_moving(available: Col = "available_units", fulfilled: Col = "units_fulfilled") -> Column:
    return (c(available) > 0) & (c(fulfilled) == 0)


def flag(condition: Column) -> Column:
    """1.0 where a condition holds, else 0.0 (unknown too)."""
    return F.when(condition, 1.0).otherwise(0.0)


def rate(condition: Column) -> Column:
    """Share of rows where a condition holds."""
    return F.avg(flag(condition))


def _millionths(x: Col) -> Column:
    """An amount in whole millionths, halves away from zero. The product with 10^6 decides, not the shortest text of the number."""
    scaled_up = dbl(x) * 1e6
    whole = F.floor(F.abs(scaled_up) + 0.5)
    return F.when(scaled_up < 0, -whole).otherwise(whole).cast("decimal(18,0)")


def exact(x: Col) -> Column:
    """An amount as a decimal of six places."""
    return (_millionths(x) * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")


#: Bits of the lower part of an amount's millionths. Sums of both parts are longs, far cheaper than sums of wide decimals.
_LOW_BITS = 30


def money_parts(x: Col) -> tuple[Column, Column]:
    """An amount in millionths as two longs that are summed apart: how many 2^30, and the rest (never negative)."""
    whole = _millionths(x).cast("long")
    return F.shiftright(whole, _LOW_BITS), whole.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))


def money_whole(high: Col, low: Col) -> Column:
    """The amount of two (summed) parts, as an exact decimal of six places."""
    kind = "decimal(20,0)"
    return (c(high).cast(kind) * F.lit(Decimal(1 << _LOW_BITS)) + c(low).cast(kind)) * F.lit(Decimal("0.000001"))


def exact_sum(x: Col) -> Column:
    """Sum of amounts as decimals of six places, which does not depend on the order of rows."""
    return money_whole(*map(F.sum, money_parts(x)))


def money_sum(x: Col) -> Column:
    """``exact_sum`` as a double."""
    return exact_sum(x).cast("double")


def money_total(x: Col) -> Column:
    """Sum of amounts that are sums themselves: as ``money_sum``, with room for 32 digits before the point."""
    return F.sum(c(x).cast("decimal(38,6)")).cast("double")


def money_mean(x: Col) -> Column:
    return money_sum(x) / F.nullif(F.count(c(x)), F.lit(0)).cast("double")


def day_bit(day: Col = "date") -> Column:
    """One bit for the day of its month: ``bit_or`` merges days, ``bit_count`` counts them, in any order and without distinct rows."""
    return F.call_function("shiftleft", F.lit(1), F.dayofmonth(c(day)) - 1)


def month_of(day: Col = "date") -> Column:
    return F.trunc(c(day), "month")


#: Upper bounds (excluded) and labels of the days-of-supply histogram.
DOS_BUCKETS = ((5, "00_<5"), (10, "01_5_to_10"), (20, "02_10_to_20"), (35, "03_20_to_35"), (50, "04_35_to_50"))


def dos_bucket(days: Col = "days_of_supply") -> Column:
    first, *rest = DOS_BUCKETS
    out = F.when(c(days) < first[0], first[1])
    for bound, label in rest:
        out = out.when(c(days) < bound, label)
    return out.otherwise("05_50_plus")


def criticality_weight(level: Col, unknown: float) -> Column:
    return F.when(c(level) == "High", 1.0).when(c(level) == "Medium", 0.6).when(c(level) == "Low", 0.3).otherwise(unknown)

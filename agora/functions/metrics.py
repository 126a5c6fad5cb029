"""Column helpers shared by the operators: rounding, shares, day spans.

Rounding rule (used by every operator and by the oracle SQL): a value is
first fixed at ten decimals, then rounded half away from zero at the
requested scale and reported as DOUBLE. That makes ROUND(1.005, 2) = 1.01
whatever engine computed the unrounded value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(x: str | Column, scale: int) -> Column:
    """ROUND(x, scale), half away from zero, as DOUBLE."""
    return F.round(col(x).cast("decimal(38,10)"), scale).cast("double")


def money(x: str | Column) -> Column:
    """A money amount reported at two decimals."""
    return round_half_up(x, 2)


def ratio(numer: str | Column, denom: str | Column) -> Column:
    """numer / denom as DOUBLE; NULL when denom is 0 or NULL (never an error)."""
    return col(numer).cast("double") / F.nullif(col(denom), F.lit(0)).cast("double")


def mean(total: str | Column, count: str | Column, scale: int = 2) -> Column:
    """total / count rounded to ``scale``, NULL for a zero count.

    The exact sum is divided in floating point: a decimal division would
    first cut the quotient to a few places (1.0049997 to 1.005) and the
    rounding would then be of that (1.01 where 1.00 is right)."""
    return round_half_up(ratio(total, count), scale)


def pct(numer: str | Column, denom: str | Column, scale: int) -> Column:
    """numer * 100 / denom rounded to ``scale``; NULL for a zero denominator.

    The numerator is scaled exactly (integer or decimal) before the single
    floating-point division.
    """
    return round_half_up(ratio(col(numer) * F.lit(100), denom), scale)


def days_between(start: str | Column, end: str | Column) -> Column:
    """Fractional days from ``start`` to ``end`` (timestamp_ntz or timestamp)."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(MICROS_PER_DAY)


def line_revenue() -> Column:
    """Item revenue: price plus freight (exact decimal)."""
    return F.col("price") + F.col("freight_value")


def ts_literal(value: str) -> Column:
    """A timestamp_ntz literal; no session time zone is involved."""
    return F.lit(value).cast("timestamp_ntz")


def month_label(ts: str | Column) -> Column:
    """'yyyy-MM' of a timestamp, from the year and month of its date, which
    for timestamp_ntz involves no time zone (``date_format`` would convert
    through the session zone and move times in a DST gap). The string cast,
    several times slower, is left to years of other than four digits."""
    day = col(ts).cast("date")
    number = (F.year(day) * 100 + F.month(day)).cast("string")
    plain = F.concat(F.substring(number, 1, 4), F.lit("-"), F.substring(number, 5, 2))
    return F.when(F.year(day).between(1000, 9999), plain).otherwise(F.substring(col(ts).cast("string"), 1, 7))


def timestamp_text(ts: str | Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss', or just 'yyyy-MM-dd' at midnight; zone-free."""
    text = col(ts).cast("string")
    return F.when(text.endswith(" 00:00:00"), F.substring(text, 1, 10)).otherwise(text)

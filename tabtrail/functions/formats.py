"""Number and duration formatting with the rounding rules of the reproduced UI.

Half-up rounding of a ratio is done in exact integer arithmetic on the integer sums
(``floor((2*a*10^n + b) / (2*b))``), never by formatting a double, so results are
identical in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _s(x) -> Column:
    return x.cast("string")


def idiv(x, y) -> Column:
    """Exact floor division of integer columns (bigint), null when ``y`` is 0."""
    x, y = _c(x).cast("long"), _c(y).cast("long") if not isinstance(y, int) else F.lit(y)
    y = F.nullif(y.cast("long"), F.lit(0))
    return ((x - F.pmod(x, y)) / y).cast("long")


def js_round(x) -> Column:
    """Round half toward +infinity: ``floor(x + 0.5)`` as bigint."""
    return F.floor(_c(x) + F.lit(0.5)).cast("long")


def minutes_rounded(ms) -> Column:
    """Whole minutes of a millisecond amount, rounded half up."""
    return js_round(_c(ms) / F.lit(60000.0))


def format_hm(ms) -> Column:
    """``Hh Mm`` when at least one hour, else ``Mm`` (floors)."""
    m = idiv(ms, 60000)
    h = idiv(m, 60)
    return F.when(h > 0, F.concat(_s(h), F.lit("h "), _s(m - h * 60), F.lit("m"))) \
        .otherwise(F.concat(_s(m), F.lit("m")))


def format_hms(ms) -> Column:
    """``Hh Mm`` / ``Mm Ss`` / ``Ss``."""
    x = _c(ms).cast("long")
    m = idiv(x, 60000)
    s = idiv(x - m * 60000, 1000)
    h = idiv(m, 60)
    return (F.when(h > 0, F.concat(_s(h), F.lit("h "), _s(m - h * 60), F.lit("m")))
            .when(m > 0, F.concat(_s(m), F.lit("m "), _s(s), F.lit("s")))
            .otherwise(F.concat(_s(s), F.lit("s"))))


def format_clock(ms) -> Column:
    """``H:MM:SS`` when at least one hour, else ``M:SS``."""
    t = idiv(ms, 1000)
    h = idiv(t, 3600)
    m = idiv(t - h * 3600, 60)
    s = t - h * 3600 - m * 60
    mm = F.lpad(_s(m), 2, "0")
    ss = F.lpad(_s(s), 2, "0")
    return F.when(h > 0, F.concat(_s(h), F.lit(":"), mm, F.lit(":"), ss)) \
        .otherwise(F.concat(_s(m), F.lit(":"), ss))


def fixed_ratio(num, den, digits: int, scale: int = 1) -> Column:
    """``(num * scale / den)`` rounded half up to ``digits`` decimals, as text.

    ``num`` and ``den`` are integer columns; null when ``den`` is 0 or null.
    """
    n, d = _c(num).cast("long"), _c(den).cast("long")
    p = 10 ** digits
    units = idiv(n * (2 * p * scale) + d, d * 2)
    whole = idiv(units, p)
    frac = F.lpad(_s(units - whole * p), digits, "0")
    return F.concat(_s(whole), F.lit("."), frac)


def percent_1(part, total) -> Column:
    """Share of ``part`` in ``total`` in percent with one decimal (``toFixed(1)``)."""
    return fixed_ratio(part, total, 1, 100)

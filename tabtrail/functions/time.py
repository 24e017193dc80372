"""Epoch-millisecond time helpers that do not depend on the session time zone.

Timestamps in the data model are epoch milliseconds (``LongType``). Wall-clock values
are produced as ``TIMESTAMP_NTZ`` so that formatting, ``hour`` and ``to_date`` never
consult ``spark.sql.session.timeZone``; a zone is always an explicit argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabtrail.constants import DAY_MS

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz_to_ms(ts) -> Column:
    """Epoch ms of a timestamp without zone read as UTC wall time (truncates micros).

    Built from calendar fields, which for ``TIMESTAMP_NTZ`` involve no time zone.
    """
    t = _c(ts)
    millis_of_sec = F.floor(F.extract(F.lit("SECOND"), t) * 1000).cast("long")
    return (F.unix_date(F.to_date(t)).cast("long") * DAY_MS
            + F.hour(t).cast("long") * 3_600_000 + F.minute(t).cast("long") * 60_000
            + millis_of_sec)


def ntz_literal(ms: int) -> Column:
    """Epoch ms as a ``TIMESTAMP_NTZ`` literal (UTC wall time)."""
    import datetime as dt
    wall = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    return F.expr(f"TIMESTAMP_NTZ'{wall.isoformat(sep=' ', timespec='milliseconds')}'")


def utc_wall(ms) -> Column:
    """UTC wall-clock ``TIMESTAMP_NTZ`` of an epoch-ms column."""
    return F.timestamp_add("MILLISECOND", _c(ms), F.expr(_EPOCH_NTZ))


def local_wall(ms, tz: str = "UTC") -> Column:
    """Wall-clock ``TIMESTAMP_NTZ`` of epoch ms in time zone ``tz``."""
    wall = utc_wall(ms)
    if _is_utc(tz):
        return wall
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), wall)


def local_day(ms, tz: str = "UTC") -> Column:
    """Calendar date (``DateType``) of epoch ms in ``tz``."""
    return F.to_date(local_wall(ms, tz))


def _is_utc(tz: str) -> bool:
    return tz in ("UTC", "Z", "+00:00", "GMT")


def _floor_div(x: Column, n: int) -> Column:
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("long")


def utc_date(ms) -> Column:
    """UTC calendar date (``DateType``) by integer arithmetic (no time-zone lookup)."""
    return F.date_from_unix_date(_floor_div(_c(ms).cast("long"), DAY_MS).cast("int"))


def utc_day(ms) -> Column:
    """ISO date string ``yyyy-MM-dd`` of epoch ms in UTC."""
    return utc_date(ms).cast("string")


def day_string(ms, tz: str = "UTC") -> Column:
    """ISO date string of epoch ms in time zone ``tz``."""
    if _is_utc(tz):
        return utc_day(ms)
    return F.to_date(local_wall(ms, tz)).cast("string")


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def iso_ts(ms) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.sssZ`` of epoch ms (UTC), by integer arithmetic."""
    x = _c(ms).cast("long")
    in_day = F.pmod(x, F.lit(DAY_MS))
    return F.concat(utc_day(x), F.lit("T"),
                    _pad(_floor_div(in_day, 3_600_000), 2), F.lit(":"),
                    _pad(F.pmod(_floor_div(in_day, 60_000), F.lit(60)), 2), F.lit(":"),
                    _pad(F.pmod(_floor_div(in_day, 1000), F.lit(60)), 2), F.lit("."),
                    _pad(F.pmod(in_day, F.lit(1000)), 3), F.lit("Z"))


def local_hour(ms, tz: str = "UTC") -> Column:
    if _is_utc(tz):
        return _floor_div(F.pmod(_c(ms).cast("long"), F.lit(DAY_MS)), 3_600_000).cast("int")
    return F.hour(local_wall(ms, tz))

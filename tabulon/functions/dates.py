"""Dates and durations: serial day numbers, parts, shifts, business days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import NAN, col, num

#: Day number of 1970-01-01.
EPOCH = 719529
_DAY = 86400.0


def datetime(y, m, d, h=0, mi=0, s=0) -> Column:
    return F.make_timestamp_ntz(col(y).cast("int"), col(m).cast("int"), col(d).cast("int"), col(h).cast("int"), col(mi).cast("int"), col(s).cast("double"))


def datenum(t) -> Column:
    """Serial day number of a timestamp; NaN for missing."""
    t = col(t)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date"))
    secs = F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("SECOND"), t).cast("double")
    return F.coalesce(days + EPOCH + secs / _DAY, F.lit(NAN))


def from_datenum(x) -> Column:
    x = num(x)
    micros = F.round((x - EPOCH) * _DAY * 1e6).cast("bigint")
    return F.when(~F.isnan(x), F.timestamp_micros(micros))


def year(t) -> Column:
    return F.year(col(t))


def quarter(t) -> Column:
    return F.quarter(col(t))


def month(t) -> Column:
    return F.month(col(t))


def day(t) -> Column:
    return F.dayofmonth(col(t))


def weekday(t) -> Column:
    """1 is Sunday."""
    return F.dayofweek(col(t))


def hour(t) -> Column:
    return F.hour(col(t))


def minute(t) -> Column:
    return F.minute(col(t))


def second(t) -> Column:
    return F.extract(F.lit("SECOND"), col(t)).cast("double")


def datevec(t) -> Column:
    return F.array(*[f(t).cast("double") for f in (year, month, day, hour, minute, second)])


def datestr(t, fmt: str = "dd-MMM-yyyy HH:mm:ss") -> Column:
    return F.date_format(col(t), fmt)


def dateshift(t, where: str, unit: str) -> Column:
    """Start or end of the unit that holds t; the end of a month or year is its last day."""
    start = F.date_trunc(unit, col(t))
    if where == "start":
        return start
    step = {"year": "INTERVAL 1 YEAR", "quarter": "INTERVAL 3 MONTH", "month": "INTERVAL 1 MONTH", "week": "INTERVAL 7 DAY", "day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR", "minute": "INTERVAL 1 MINUTE"}[unit]
    last = start + F.expr(step)
    return last - F.expr("INTERVAL 1 DAY") if unit in ("year", "quarter", "month", "week") else last


def calmonths(t, n: int) -> Column:
    """Calendar months later, clamped to the month's last day, time of day kept."""
    return col(t) + F.make_ym_interval(F.lit(0), F.lit(n))


def calyears(t, n: int) -> Column:
    return col(t) + F.make_ym_interval(F.lit(n), F.lit(0))


def isbetween(t, a, b, closed: str = "closed") -> Column:
    t, a, b = col(t), F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")
    left = t >= a if closed in ("closed", "openright") else t > a
    right = t <= b if closed in ("closed", "openleft") else t < b
    return F.coalesce(left & right, F.lit(False))


def isbusday(t) -> Column:
    return ~F.dayofweek(col(t)).isin(1, 7)


def fbusdate(y, m) -> Column:
    """First business day of a month."""
    first = F.make_date(col(y).cast("int"), col(m).cast("int"), F.lit(1))
    w = F.dayofweek(first)
    return F.date_add(first, F.when(w == 1, 1).when(w == 7, 2).otherwise(0))


def lbusdate(y, m) -> Column:
    last = F.last_day(F.make_date(col(y).cast("int"), col(m).cast("int"), F.lit(1)))
    w = F.dayofweek(last)
    return F.date_sub(last, F.when(w == 1, 2).when(w == 7, 1).otherwise(0))


def duration(h, m=0, s=0) -> Column:
    return F.make_dt_interval(F.lit(0), col(h).cast("int"), col(m).cast("int"), col(s).cast("decimal(18,6)"))


def seconds(d) -> Column:
    """Length of an interval between two timestamps in seconds."""
    return d.cast("interval day to second").cast("decimal(18,6)").cast("double")


def elapsed(a, b, unit: str = "seconds") -> Column:
    """b - a as a number of units."""
    us = F.unix_micros(col(b).cast("timestamp")) - F.unix_micros(col(a).cast("timestamp"))
    return us / {"milliseconds": 1e3, "seconds": 1e6, "minutes": 6e7, "hours": 3.6e9, "days": 8.64e10}[unit]

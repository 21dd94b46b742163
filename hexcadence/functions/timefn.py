"""Column expressions for clock text, timestamps and calendar bins.

Bins are computed on dates, not on instants, so the session time zone never shifts them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency names, their codes, and the period of each cyclic part.
FREQ_CODES = {
    "monthly_start": "MS",
    "monthly_end": "ME",
    "monthly": "M",
    "daily": "D",
    "weekly": "W",
    "two_weekly": "2W",
    "hourly": "H",
}
CYCLE_LENGTH = {"month": 12, "week": 52, "day": 30, "weekday": 7, "hour": 24}

N_WEEK_NAMES = {2: "two", 3: "three", 4: "four", 5: "five"}
N_WEEK_ANCHOR = "2000-01-03"


@dataclass(frozen=True)
class Frequency:
    """A bin width: ``count`` units of ``unit`` (hour, day, week, month)."""

    code: str
    unit: str
    count: int = 1

    @property
    def step(self) -> Column:
        if self.unit == "month":
            return F.expr(f"interval {self.count} month")
        if self.unit == "week":
            return F.expr(f"interval {7 * self.count} day")
        return F.expr(f"interval {self.count} {self.unit}")


def frequency(name: str) -> Frequency:
    """Resolve a frequency name or code; an unknown one raises ``KeyError``."""
    code = FREQ_CODES.get(name, name)
    if code in ("M", "MS", "ME"):
        return Frequency(code, "month")
    if code == "D":
        return Frequency(code, "day")
    if code == "H":
        return Frequency(code, "hour")
    if code == "W":
        return Frequency(code, "week")
    if code in ("2W", "3W", "4W", "5W"):
        return Frequency(code, "week", int(code[0]))
    raise KeyError(f"frequency {name!r} is not allowed; use one of {sorted(FREQ_CODES)}")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _midnight(date: Column) -> Column:
    return date.cast("timestamp_ntz")


def n_week_start(ts: Column | str, weeks: int) -> Column:
    """Start of the ``weeks``-wide bin on the Monday grid anchored at 2000-01-03."""
    day = _col(ts).cast("date")
    monday = F.date_sub(day, F.weekday(day))
    anchor = F.lit(N_WEEK_ANCHOR).cast("date")
    week_no = F.floor(F.datediff(monday, anchor) / F.lit(7 * weeks)).cast("int")
    return _midnight(F.date_add(anchor, week_no * F.lit(7 * weeks)))


def bin_start(ts: Column | str, freq: str | Frequency) -> Column:
    """Period start of a timestamp: hour, day, Monday week, n-week grid or month."""
    f = freq if isinstance(freq, Frequency) else frequency(freq)
    ts = _col(ts)
    day = ts.cast("date")
    if f.unit == "month":
        return _midnight(F.trunc(day, "MM"))
    if f.unit == "week":
        if f.count > 1:
            return n_week_start(ts, f.count)
        return _midnight(F.date_sub(day, F.weekday(day)))
    if f.unit == "hour":
        return _midnight(day) + F.make_dt_interval(F.lit(0), F.hour(ts))
    return _midnight(day)


def parse_hhmm(text: Column | str) -> Column:
    """``HHMM``, ``HMM`` or ``H:M`` to ``HH:MM``; anything else is null.

    Three-digit values are not range-checked, four-digit and colon values are.
    """
    s = F.trim(_col(text).cast("string"))
    colon = s.rlike(r"^[0-9]{1,2}:[0-9]{1,2}$")
    four = F.when(
        colon,
        F.concat(
            F.lpad(F.split_part(s, F.lit(":"), F.lit(1)), 2, "0"),
            F.lpad(F.split_part(s, F.lit(":"), F.lit(2)), 2, "0"),
        ),
    ).when(s.rlike(r"^[0-9]{4}$"), s)
    in_range = (F.substring(four, 1, 2) <= "23") & (F.substring(four, 3, 2) <= "59")
    return F.when(
        s.rlike(r"^[0-9]{3}$"),
        F.concat(F.lit("0"), F.substring(s, 1, 1), F.lit(":"), F.substring(s, 2, 2)),
    ).when(
        four.isNotNull() & in_range,
        F.concat(F.substring(four, 1, 2), F.lit(":"), F.substring(four, 3, 2)),
    )


def clock_part(hhmm: Column | str, part: str) -> Column:
    """Hour or minute of a valid ``HH:MM`` text; null where the clock time does not exist."""
    c = _col(hhmm)
    h = F.substring(c, 1, 2).try_cast("int")
    m = F.substring(c, 4, 2).try_cast("int")
    ok = (h <= 23) & (m <= 59)
    return F.when(ok, h if part == "hour" else m)


def make_timestamp(year, month, day, hour, minute) -> Column:
    """Timestamp from parts; an impossible combination is null."""
    as_int = [_col(c).cast("int") for c in (year, month, day, hour, minute)]
    return F.try_make_timestamp_ntz(*as_int, F.lit(0).cast("decimal(16,6)"))


def time_part(ts: Column | str, part: str) -> Column:
    """Calendar or clock part; weekday counts from Monday = 0, week is the ISO week."""
    ts = _col(ts)
    parts = {
        "year": F.year,
        "month": F.month,
        "week": F.weekofyear,
        "day": F.dayofmonth,
        "weekday": F.weekday,
        "hour": F.hour,
        "minute": F.minute,
    }
    if part == "second":
        return F.second(ts).cast("int")
    return parts[part](ts).cast("int")


TIME_PARTS = ("year", "month", "week", "day", "weekday", "hour", "minute", "second")


def cyclic(value: Column | str, part: str) -> tuple[Column, Column]:
    """Sine and cosine of a part on its cycle."""
    angle = F.lit(2 * math.pi) * _col(value) / F.lit(CYCLE_LENGTH[part])
    return F.sin(angle), F.cos(angle)


def is_rush_hour(hour: Column | str) -> Column:
    h = _col(hour)
    return F.when(h.between(7, 9) | h.between(16, 18), 1).otherwise(0)

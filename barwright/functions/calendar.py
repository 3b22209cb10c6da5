"""Clock and session columns. Times are epoch seconds in UTC; IST is the fixed offset of 5 h 30 min."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IST = 19_800
DAY = 86_400
#: Session names and hours (IST), half-open (fixed values).
SESSIONS = [("ASIA", 2.5, 11.5), ("LONDON", 11.5, 15.5), ("OVERLAP", 15.5, 17.5), ("NY", 17.5, 21.5)]
RISK_SESSIONS = [("LONDON_OPEN", 11.5, 15.5), ("NY_MORNING", 17.5, 21.5), ("LONDON_NY_OVERLAP", 15.5, 19.5)]
WINDOW, ROLLOVER_MINUTES, FRIDAY_STOP = (6.0, 21.5), 10, 21.0


def ist_hour(t: Column) -> Column:
    """Hour of the IST day with its fraction, in [0, 24)."""
    return F.pmod(t + IST, F.lit(DAY)) / F.lit(3600.0)


def ist_day(t: Column) -> Column:
    return F.floor((t + IST) / DAY)


def ist_week(t: Column) -> Column:
    """Weeks of seven IST days from the epoch (they begin on Thursdays)."""
    return F.floor((t + IST) / (7 * DAY))


def utc_day(t: Column) -> Column:
    return F.floor(t / DAY)


def weekday(day: Column) -> Column:
    """0 is Monday; day counts from the epoch, a Thursday."""
    return F.pmod(day + 3, F.lit(7))


def in_session(hour: Column, a: float, b: float) -> Column:
    """hour in [a, b): b past 24 or b below a wraps over midnight, a = b is the whole day."""
    if a == b:
        return F.lit(True)
    if b > 24:
        return (hour >= a) | (hour < b - 24)
    return (hour >= a) & (hour < b) if a < b else (hour >= a) | (hour < b)


def session_of(hour: Column) -> Column:
    out = F.lit("LATE")
    for name, a, b in reversed(SESSIONS):
        out = F.when(in_session(hour, a, b), name).otherwise(out)
    return out


def risk_session_of(hour: Column) -> Column:
    out = F.lit("ASIA_OVERNIGHT")
    for name, a, b in reversed(RISK_SESSIONS):
        out = F.when(in_session(hour, a, b), name).otherwise(out)
    return out


def stop_multiplier(hour: Column) -> Column:
    return F.when(in_session(hour, 11.5, 21.5), 1.5).otherwise(2.0)


def entry_block(t: Column) -> Column:
    """Why no position may be opened at t; null if one may. The first reason that holds is given."""
    hour, day = ist_hour(t), weekday(ist_day(t))
    minute = F.floor(F.pmod(t, F.lit(DAY)) / 60)
    return (
        F.when((day >= 5) | ((day == 0) & (hour < 3.5)), "weekend")
        .when(~in_session(hour, *WINDOW), "window")
        .when((day == 4) & (hour >= FRIDAY_STOP), "friday")
        .when(F.least(minute, 1440 - minute) <= ROLLOVER_MINUTES, "rollover")
    )


def month_ist(t: Column) -> Column:
    return F.date_format(F.timestamp_seconds(t + IST), "yyyy-MM")

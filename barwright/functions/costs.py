"""Holding costs and position sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
#: (balance below, lots an order, total lots, positions) and (balance from, lots an order, positions, exposure), fixed values.
RISK_LADDER = [(200.0, 0.01, 0.01, 1), (400.0, 0.01, 0.02, 2), (800.0, 0.01, 0.03, 3), (None, 0.02, 0.06, 3)]
SIZE_LADDER = [(0.0, 0.01, 1, 0.01), (100.0, 0.01, 2, 0.02), (200.0, 0.01, 2, 0.02), (400.0, 0.01, 3, 0.03), (800.0, 0.02, 2, 0.04), (1200.0, 0.02, 3, 0.06)]
FLOOR = 50.0


def nights(entry: Column, exit_: Column, rollover_hour: float = 0.0) -> Column:
    """Rollovers between two times."""
    off = rollover_hour * 3600
    return F.when(exit_ > entry, F.floor((exit_ - off) / DAY) - F.floor((entry - off) / DAY)).otherwise(0)


def swap_units(entry: Column, exit_: Column, triple_weekday: int = 2, rollover_hour: float = 0.0) -> Column:
    """Nights, three for each that ends on the triple weekday: counted by whole weeks and a rest, without listing days."""
    off = rollover_hour * 3600
    a, b = F.floor((entry - off) / DAY), F.floor((exit_ - off) / DAY)
    upto = lambda d: F.floor((d + 3 - triple_weekday) / 7)  # noqa: E731  days up to d that are that weekday
    return F.when(exit_ > entry, (b - a) + 2 * (upto(b) - upto(a))).otherwise(0)


def swap(lots: Column, is_buy: Column, units: Column, long_points: float = -515.5, short_points: float = 0.0, point: float = 0.001, value: float = 100.0) -> Column:
    return F.when(is_buy, long_points).otherwise(short_points) * point * value * lots * units


def risk_ladder(balance: Column, field: int) -> Column:
    """lots (1), total lots (2) or positions (3) for a balance."""
    out = F.lit(RISK_LADDER[-1][field])
    for row in reversed(RISK_LADDER[:-1]):
        out = F.when(balance < row[0], F.lit(row[field])).otherwise(out)
    return out


def size_ladder(balance: Column, field: int) -> Column:
    """lots (1), positions (2) or exposure (3) for a balance; null below the floor."""
    out = F.lit(SIZE_LADDER[0][field])
    for row in SIZE_LADDER[1:]:
        out = F.when(balance >= row[0], F.lit(row[field])).otherwise(out)
    return F.when(balance >= FLOOR, out)


def lot_size(balance: Column, risk_pct: float, stop: Column, contract: float = 100.0, step: float = 0.01, least: float = 0.01, most: float = 1.0) -> Column:
    """Risked money over the stop's money for one lot, on the lot grid, within limits."""
    raw = balance * risk_pct / 100 / (stop * contract)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(F.bround(raw / step) * step, 2)))

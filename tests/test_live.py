"""Live operators in small batches with restarts: hand cases, and the same result however the rows are cut."""

import pytest
from pyspark.sql import functions as F

from barwright.plans import live as plans
from barwright.streaming import live

MINUTE, HOUR, DAY = 60, 3600, 86_400
MONDAY = 1_704_652_200  # 2024-01-08 00:00 IST


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def account(rows):
    """(t, balance, pl) rows of one account; equity is the balance."""
    return [(F_ts, "a", F_ts, k, float(b), float(b), 0.0, None if pl is None else float(pl)) for k, (F_ts, b, pl) in enumerate(rows)]


RISK = "ts long, account string, t long, seq long, balance double, equity double, margin double, pl double"


def gate(spark, rows, batches=3):
    df = spark.createDataFrame(account(rows), RISK).withColumn("ts", F.timestamp_seconds("ts"))
    return {r["seq"]: r for r in plans.replayed(df, "ts", live.risk_gate, batches).collect()}


def test_streak_pauses_and_stops_the_day(spark):
    rows = [(MONDAY + k * MINUTE, 1000 - k, -1) for k in range(3)] + [(MONDAY + 5 * HOUR, 997, None), (MONDAY + 5 * HOUR + 1, 996, -1), (MONDAY + 5 * HOUR + 2, 995, -1), (MONDAY + 12 * HOUR, 995, None), (MONDAY + DAY, 995, None), (MONDAY + DAY + 1, 996, 1)]
    got = gate(spark, rows)
    assert [got[k]["reason"] for k in range(9)] == ["allowed", "allowed", "paused", "allowed", "paused", "stopped", "stopped", "allowed", "allowed"]
    assert [got[k]["streak"] for k in range(9)] == [1, 2, 3, 3, 4, 5, 5, 5, 0] and got[7]["day_losers"] == 0


def test_falls_from_anchors(spark):
    """Day, week and month begin with the balance of their first row; a fall from the peak halts for good."""
    rows = [(MONDAY, 1000, None), (MONDAY + HOUR, 945, None), (MONDAY + 2 * HOUR, 940, None), (MONDAY + DAY, 900, None), (MONDAY + 2 * DAY, 850, None), (MONDAY + 7 * DAY, 850, None), (MONDAY + 24 * DAY, 760, None), (MONDAY + 25 * DAY, 690, None), (MONDAY + 26 * DAY, 5000, None)]
    got = gate(spark, rows, 4)
    assert [got[k]["reason"] for k in range(9)] == ["allowed", "allowed", "day", "allowed", "week", "allowed", "allowed", "peak", "halted"]
    low = [(MONDAY, 300, -1), (MONDAY + 1, 299, -1), (MONDAY + DAY, 299, None), (MONDAY + DAY + 1, 289, None), (MONDAY + 2 * DAY, 0, None)]
    got = gate(spark, low)
    assert [got[k]["reason"] for k in range(5)] == ["allowed", "losers", "allowed", "day", "peak"]


@pytest.mark.parametrize("batches", [1, 5])
def test_duplicates_expire(spark, batches):
    times = [0, 10, 7199, 7200, 7300, 40_000, 40_001]
    df = spark.createDataFrame([(MONDAY + t, MONDAY + t, k, "x", i) for i in range(2) for k, t in enumerate(times)], "ts long, t long, seq long, name string, i long").withColumn("ts", F.timestamp_seconds("ts"))
    got = collected(plans.replayed(df, "ts", lambda s: live.first_seen(s, ["name", "i"], 7200), batches).select("key", "t"))
    assert sorted(t - MONDAY for k, t in got if k.endswith("0")) == [0, 7200, 40_000] and len(got) == 6


def test_duplicates_of_many_keys_in_order_of_time(spark):
    """The earliest row of a second passes, not the least seq; keys that share a state don't stop each other."""
    rows = [(MONDAY + 0.9, MONDAY, 2 * k, k) for k in range(300)] + [(MONDAY + 0.1, MONDAY, 2 * k + 1, k) for k in range(300)] + [(MONDAY + 7200.5, MONDAY + 7200, 1000 + k, k) for k in range(300)]
    df = spark.createDataFrame(rows, "s double, t long, seq long, k long").select(F.timestamp_seconds("s").alias("ts"), "t", "seq", "k")
    got = plans.replayed(df, "ts", lambda s: live.first_seen(s, ["k"], 7200), 2).collect()
    assert sorted((int(r["key"]), r["seq"]) for r in got) == sorted([(k, 2 * k + 1) for k in range(300)] + [(k, 1000 + k) for k in range(300)])


@pytest.mark.parametrize("batches", [1, 4])
def test_confirmations(spark, batches):
    bars = [(0, 10.0, 1), (1, 11.0, 0), (2, 11.0, -1), (3, 11.5, 1), (4, 11.5, 1), (9, 20.0, 0), (10, 21.0, -1)]
    df = spark.createDataFrame([(MONDAY + t * HOUR, "a", MONDAY + t * HOUR, c, s) for t, c, s in bars], "ts long, symbol string, time long, close double, side long").withColumn("ts", F.timestamp_seconds("ts"))
    got = sorted(((r["time"] - MONDAY) // HOUR, r["outcome"], (r["at"] - MONDAY) / HOUR) for r in plans.replayed(df, "ts", lambda s: live.confirmed(s, 5400), batches).collect())
    assert got == [(0, "confirmed", 1.0), (2, "dropped", 3.0), (3, "dropped", 4.0), (4, "expired", 5.5)]


def test_late_and_missing_closes(spark):
    """A close that arrives a batch late within the watermark is met; an order without one comes once none can follow."""
    rows = [(0, 1, "order", 100), (MINUTE * 30, 2, "order", 101), (MINUTE * 31, 1, "close", 900), (MINUTE * 29, 1, "close", 901), (HOUR * 3, 3, "order", 102), (HOUR * 9, 9, "order", 103), (HOUR * 9, 9, "close", 904)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "s long, ticket long, kind string, id long, k long").withColumn("ts", F.timestamp_seconds(F.col("s") + MONDAY))
    of = lambda s, kind, name: s.where(F.col("kind") == kind).select("ticket", "ts", F.col("id").alias(name))
    # cut by arrival, not by time: row 3 comes after row 2
    got = collected(plans.replayed(df, "k", lambda s: live.closes_of(of(s, "order", "order_id"), of(s, "close", "close_id"), late="10 minutes"), 7))
    assert got == [(100, 900), (100, 901), (101, None), (102, None), (103, 904)]


def test_tripwire_levels(spark):
    pls = [1.0, -1.0, 1.0, -0.9, -0.5, 3.0, 3.0, 3.0]
    df = spark.createDataFrame([("a", k, k, p) for k, p in enumerate(pls)], "account string, t long, seq long, pl double")
    got = {r["seq"]: (r["level"], r["factor"]) for r in plans.replayed(df, "t", lambda s: live.tripwire(s, 3), 3).collect()}
    assert [got[k][0] for k in range(8)] == ["early", "early", "fine", "stop", "stop", "fine", "fine", "fine"] and got[2][1] == 2.0 and got[7][1] is None


def test_gap_boxes_in_any_batches(spark):
    from barwright.operators import liquidity
    from tests.test_series import BARS, walk

    rows = walk(160, 3, step=2.0) + walk(40, 5, "b")
    df = spark.createDataFrame(rows, BARS)
    want = collected(liquidity.open_boxes(df, 9 * DAY, 0.0005).select("symbol", "time", "bulls", "bears", "support", "resistance"))
    for batches in (1, 6):
        assert collected(plans.replayed(df.select("symbol", "time", "high", "low", "close"), "time", lambda s: live.gap_boxes(s, 0.0005), batches)) == want
    assert max(r[2] for r in want) > 1


def test_pairs_of_closes_come_in_parts():
    """Many orders and closes of one ticket: each pair once, no part much above the limit."""
    import numpy as np
    import pandas as pd

    orders, closes = pd.DataFrame({"m": np.arange(200), "id": np.arange(200)}), pd.DataFrame({"m": np.arange(0, 400, 3)[::-1].copy(), "id": np.arange(134)})
    seen = np.zeros(200, bool)
    parts = list(live.Closes(50, most=100).met(orders, closes, seen))
    want = {(o, c) for o, m in zip(orders["id"], orders["m"]) for c, at in zip(closes["id"], closes["m"]) if m <= at <= m + 50}
    got = [tuple(r) for p in parts for r in p.itertuples(index=False)]
    assert len(got) == len(want) and set(got) == want and max(map(len, parts)) <= 151 and seen.all()


def test_anchors_of_many_rows():
    """Rows of a batch are taken together."""
    import numpy as np

    day, week, month = live.anchors(np.array([MONDAY, MONDAY + DAY - 1, MONDAY + 7 * DAY, MONDAY + 24 * DAY], np.int64))
    assert (day - day[0]).tolist() == [0, 0, 7, 24] and (week - day[0]).tolist() == [0, 0, 7, 21] and month.tolist() == [2024 * 12 + 1] * 3 + [2024 * 12 + 2]
    assert live.latest(np.array([False, True, False, True])).tolist() == [-1, 1, 1, 3]


def test_tripwire_at_its_limits(spark):
    """Gains and losses of 0.3 are even, whatever 0.1 + 0.2 gives."""
    df = spark.createDataFrame([("a", k, k, p) for k, p in enumerate([-0.1, -0.2, 0.3])], "account string, t long, seq long, pl double")
    assert [r["level"] for r in plans.replayed(df, "t", lambda s: live.tripwire(s, 3), 1).orderBy("seq").collect()] == ["early", "early", "fine"]

"""Gates, strategies and races with exits of their own: hand cases."""

import pytest
from pyspark.sql import functions as F

from barwright.operators import barriers, strategies, validation
from tests.test_series import BARS, HOUR, walk

DAY = 86_400


def test_each_signal_has_its_own_exit(spark):
    """A race per signal agrees with a race of all with one exit; holds end trades by the close."""
    rows = walk(300, 12, gaps=False)
    bars = barriers.numbered(spark.createDataFrame(rows, BARS)).withColumns({"spread": F.lit(0.05), "atr14": F.lit(2.0)})
    sig = bars.where("rn % 7 = 0").select("symbol", "rn", F.when(F.col("rn") % 2 == 0, 1).otherwise(-1).alias("side"))
    want = sorted(map(tuple, barriers.simulated(bars, sig.withColumn("k", F.lit("a")), 2.0, 1.0, 24, ("k",)).select("rn", "exit_rn", "outcome", "r").collect()))
    each = sig.withColumns({"k": F.lit("a"), "target": F.lit(2.0), "stop": F.lit(1.0), "hold": F.lit(24)})
    two = each.unionByName(each.withColumns({"k": F.lit("b"), "target": F.lit(50.0), "stop": F.lit(50.0), "hold": F.lit(3)}))
    got = barriers.simulated_each(bars, two, ("k",), 96)
    assert sorted(map(tuple, got.where("k = 'a'").select("rn", "exit_rn", "outcome", "r").collect())) == want and len(want) > 10
    assert all(r["outcome"] == 0 and r["exit_rn"] in (r["rn"] + 3, 300) for r in got.where("k = 'b'").collect())


def test_midnight_gate_by_hand(spark):
    base = 20_000 * DAY - 19_800  # 0:00 IST
    bars = [("a", base + h * HOUR, 100.0 + (h >= 12) * 10 - (h >= 15) * 20, 99.0) for h in range(24)]
    b = spark.createDataFrame(bars, "symbol string, time long, close double, ema20 double")
    sig = spark.createDataFrame([("a", base + h * HOUR, s) for h in (3, 13, 16) for s in (1, -1)], "symbol string, time long, signal int")
    got = {((r["time"] - base) // HOUR, r["signal"]): r["blocked"] for r in validation.midnight_gate(sig, b, 5 * DAY).collect()}
    # 4:00 UTC is 9:30 IST: the bar of 9:00, at 100
    assert got == {(3, 1): False, (3, -1): False, (13, 1): True, (13, -1): False, (16, 1): False, (16, -1): True}


def test_clean_reversals_by_hand(spark):
    rows = [(0, 10, 11, 9, 10.5, 10.0), (1, 10.5, 10.6, 8.0, 8.2, 9.0), (2, 8.2, 8.3, 8.0, 8.1, 8.5), (3, 8.1, 9.5, 8.0, 9.4, 8.6)]
    b = spark.createDataFrame([("a", n, *map(float, r)) for n, *r in rows], "symbol string, rn long, open double, high double, low double, close double, ema20 double")
    got = {r["rn"]: (r["against_long"], r["against_short"]) for r in validation.clean_reversals(b).collect()}
    assert got == {0: (False, False), 1: (True, False), 2: (False, False), 3: (False, True)}


def test_regimes_count_a_trade_three_times(spark):
    bars = spark.createDataFrame([("s", i * HOUR, i, 100.0 + i, float(i % 5)) for i in range(40)], "symbol string, time long, rn long, close double, atr14 double")
    trades = spark.createDataFrame([("s", "s", t * HOUR + 5, pl) for t, pl in ((5, 9.0), (20, 4.0), (21, -2.0), (22, 1.0))], "symbol string, strategy string, entry_time long, net_pl double")
    got = {r["regime"]: (r["trades"], r["profit_factor"], r["net_pl"]) for r in validation.regimes(trades, bars, DAY, 10).collect()}
    assert got == {"trend_up": (3, 2.5, 3.0), "leg_s": (3, 2.5, 3.0), "range_0": (1, None, 4.0), "range_1": (1, 0.0, -2.0), "range_2": (1, None, 1.0)}


def test_resampled_paths(spark):
    """A path of equal gains never falls; sizes and seeds give other paths, blocks don't."""
    rows = [(k, "up", 1.0) for k in range(50)] + [(k, "both", -30.0 if k % 2 else 28.0) for k in range(60)]
    t = spark.createDataFrame(rows, "trade_id long, strategy string, net_pl double").repartition(3)
    one, two = (sorted(map(tuple, validation.resampled_paths(t, 70, 100.0, block=b).collect()), key=str) for b in (7, 250))
    assert one == two and len(one) == 140
    got = {r["strategy"]: r for r in validation.path_summary(validation.resampled_paths(t, 70, 100.0)).collect()}
    assert got["up"]["drawdown_p95"] == 0 and got["up"]["pf_p50"] is None and got["up"]["passed"] and not got["both"]["passed"] and got["both"]["touch_75"] >= got["both"]["touch_20"] > 0


def test_held_out_splits_by_time(spark):
    t = spark.createDataFrame([("s", k, 100 + 10 * k, pl) for k, pl in enumerate([5.0, -1.0, 5.0, 5.0, -40.0, -30.0])] + [("s", 99, None, 1000.0)], "strategy string, trade_id long, exit_time long, net_pl double")
    got = {r["part"]: r for r in validation.held_out(t, 0.7, 100.0).collect()}
    assert (got["train"]["trades"], got["train"]["passed"], got["test"]["trades"], got["test"]["least_balance"], got["test"]["passed"]) == (4, True, 2, 30.0, False)
    assert got["test"]["drawdown_pct"] == 70.0


@pytest.fixture(scope="module")
def fired(spark):
    rows = walk(900, 31, gaps=False)
    quarter = [(s, t // 4, *r) for s, t, *r in rows]
    later = [(*r[:2], 300.0, 400.0, 50.0, 60.0, 90) if i >= 800 else r for i, r in enumerate(quarter)]
    return quarter, *({(r["time"], r["strategy"]): r["signal"] for r in strategies.signals(spark.createDataFrame(x, BARS), 3 * DAY).collect()} for x in (quarter, later))


def test_strategies_know_no_later_bar(fired):
    quarter, one, two = fired
    end = quarter[800][1]
    assert {k: v for k, v in one.items() if k[0] < end} == {k: v for k, v in two.items() if k[0] < end} and len({k[1] for k in one}) >= 12


def test_what_strategies_remember(fired):
    _, one, _ = fired
    times = lambda name: sorted(t for t, n in one if n == name)
    days = [(t + 19_800) // DAY for t in times("asia_volatile_break")]
    assert len(days) == len(set(days))
    days = [t // DAY for t in times("daily_open_momentum")]
    assert len(days) == len(set(days))
    # an edge isn't followed by the same signal a bar later
    edge = {t: one[t, "ribbon_asia"] for t in times("ribbon_asia")}
    assert edge and not any(edge.get(t + 900) == s for t, s in edge.items())


def test_falls_in_pieces():
    """The bounded search finds what every peak and balance say, however the results are cut; a task no longer sorts pairs or holds whole paths."""
    import numpy as np

    from barwright.operators.inference import Fall

    rng = np.random.default_rng(5)
    for drift in (-1.0, 0.0, 0.3, 3.0):
        x = rng.normal(drift, 20.0, 5000)
        balance = 1000.0 + np.cumsum(x)
        peak = np.maximum(np.maximum.accumulate(balance), 1000.0)
        for relative, want in ((False, (peak - balance).max()), (True, ((peak - balance) / peak).max())):
            for size in (1, 63, 64, 1000, 5000):
                fall = Fall(1000.0, relative)
                for lo in range(0, len(x), size):
                    fall.add(x[lo : lo + size])
                assert abs(fall.most - want) <= 1e-9 * want and abs(fall.least - balance.min()) < 1e-8


def test_draws_wrap_at_32_bits():
    import numpy as np

    from barwright.operators.inference import mixed, seeds

    ids, sims = np.array([0, 1, 2**31 - 2, 2**31 - 1, 2**40 + 7], np.int64), np.arange(0, 5000, 617, dtype=np.int64)
    h = ((ids[:, None] % 2147483647) * 1103515245 + 12345) % 2147483648 ^ (sims * 69069 + 362437) % 2147483648
    for a, c, shift in ((1664525, 1013904223, 15), (22695477, 1, 13), (1103515245, 12345, 16)):
        h = (h * a + c) % 4294967296
        h = h ^ (h >> shift)
    assert (mixed(seeds(ids)[:, None], sims[None, :]).astype(np.int64) == h).all()

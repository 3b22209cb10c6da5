"""Hand-made cases: seeds, ties, wraps, gaps, state machines, files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.functions import calendar as cal
from barwright.functions import costs, numeric
from barwright.operators import barriers, bars, frames, recurrences, rules, trades
from barwright.sources import market


def make(spark, closes, symbol="a", step=3600, start=0):
    rows = [(symbol, start + i * step, c, c + 1.0, c - 1.0, c, 1) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, market.BAR_SCHEMA)


@pytest.mark.parametrize("chunk", [3600, 5 * 3600, 10**9])
def test_averages_do_not_depend_on_chunks(spark, chunk):
    x = np.random.default_rng(1).normal(size=40).cumsum() + 50
    df = make(spark, x.tolist())
    got = recurrences.averages(df, [recurrences.ema("e", "close", 7), recurrences.wilder("w", "close", 5)], chunk).orderBy("time").toPandas()

    def slow(p, k):
        out, y = [None] * (p - 1), x[:p].mean()
        out.append(y)
        for v in x[p:]:
            y += k * (v - y)
            out.append(y)
        return out

    for name, want in (("e", slow(7, 2 / 8)), ("w", slow(5, 1 / 5))):
        for g, w in zip(got[name], want, strict=True):
            assert (w is None and g != g) or abs(g - w) < 1e-9


def test_averages_short_series_and_nulls(spark):
    df = make(spark, [1.0, 2.0])
    assert recurrences.averages(df, [recurrences.ema("e", "close", 5)], 3600).where("e IS NOT NULL").count() == 0
    assert recurrences.averages(df.limit(0), [recurrences.ema("e", "close", 5)], 3600).count() == 0


def test_average_never_reads_ahead(spark):
    a = make(spark, [float(i % 7) for i in range(30)])
    b = make(spark, [float(i % 7) for i in range(29)] + [999.0])
    f = lambda d: [r["ema20"] for r in rules.features(d).orderBy("time").collect()][:29]
    assert f(a) == f(b)


def test_session_wraps(spark):
    h = spark.createDataFrame([(x,) for x in (0.0, 2.49, 2.5, 11.5, 21.5, 23.99)], "h double")
    got = [tuple(r) for r in h.select(cal.in_session(F.col("h"), 21.5, 26.5), cal.in_session(F.col("h"), 21.5, 11.5), cal.in_session(F.col("h"), 5.0, 5.0)).collect()]
    assert got == [(True, True, True), (True, True, True), (False, True, True), (False, False, True), (True, True, True), (True, True, True)]


def test_week_begins_on_thursday(spark):
    r = spark.range(1).select(cal.ist_week(F.lit(7 * 86400 - 19800 - 1)).alias("a"), cal.ist_week(F.lit(7 * 86400 - 19800)).alias("b"), cal.ist_day(F.lit(-19801)).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (0, 1, -1)


def test_swap_triple_day(spark):
    wed = 6 * 86400  # 1970-01-07, a Wednesday
    for a, b, nights, units in ((wed - 3600, wed + 3600, 1, 3), (wed + 1, wed + 2, 0, 0), (wed - 86400, wed + 86400, 2, 4), (5, 5, 0, 0)):
        r = spark.range(1).select(costs.nights(F.lit(a), F.lit(b)).alias("n"), costs.swap_units(F.lit(a), F.lit(b)).alias("u")).first()
        assert (r["n"], r["u"]) == (nights, units)


def test_round_level_half_even_and_signal_order(spark):
    r = spark.range(1).select(numeric.round_level(F.lit(12.5), 5.0).alias("a"), numeric.signal(F.lit(True), F.lit(True)).alias("s"), numeric.signal(F.lit(None).cast("boolean"), F.lit(None).cast("boolean")).alias("z")).first()
    assert (r["a"], r["s"], r["z"]) == (10.0, -1, 0)


def test_ladders(spark):
    b = spark.createDataFrame([(49.0,), (50.0,), (199.9,), (200.0,), (800.0,), (1200.0,)], "b double")
    got = [tuple(r) for r in b.select(costs.risk_ladder(F.col("b"), 3), costs.size_ladder(F.col("b"), 2)).collect()]
    assert got == [(1, None), (1, 1), (1, 2), (2, 2), (3, 2), (3, 3)]


def test_stop_wins_a_double_touch(spark):
    b = make(spark, [10.0, 10.0, 10.0, 10.0]).withColumn("atr14", F.lit(1.0))
    b = barriers.numbered(b)
    e = spark.createDataFrame([("a", 1, 1, 10.0)], "symbol string, rn int, side int, entry double")
    r = barriers.race(b, e, F.col("entry") + 1, F.col("entry") - 1, 2).collect()
    assert [(x["outcome"], x["exit_rn"]) for x in r] == [(-1, 2)]
    r = barriers.race(b, e, F.col("entry") + 9, F.col("entry") - 9, 2).collect()
    assert [(x["outcome"], x["exit_rn"]) for x in r] == [(0, 3)]


def test_one_at_a_time(spark):
    # an entry on the bar that ended the last trade doesn't count: the search goes on with the bar after it
    e = spark.createDataFrame([("a", 1, 5), ("a", 3, 9), ("a", 5, 6), ("b", 2, 3)], "symbol string, rn int, exit_rn int")
    assert sorted((r[0], r[1]) for r in barriers.one_at_a_time(e).collect()) == [("a", 1), ("b", 2)]


def test_debounce(spark):
    # bars, not hours: the series has a gap of 20 hours after bar 3
    s = spark.createDataFrame([("a", "r", n, (n + 20 * (n > 3)) * 3600) for n in (0, 1, 3, 4, 7, 8)], "symbol string, rule string, rn long, time long")
    assert sorted(r["rn"] for r in rules.debounced(s, 4).collect()) == [0, 4, 8]


def test_as_of_over_buckets(spark):
    left = spark.createDataFrame([("a", t) for t in (1, 5, 100, 1000)] + [("b", 7)], "symbol string, time long")
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 90, 90.0)], "symbol string, time long, v double")
    got = {(r["symbol"], r["time"]): r["v"] for r in bars.as_of(left, right, ["v"], 10).collect()}
    assert got == {("a", 1): None, ("a", 5): 50.0, ("a", 100): 90.0, ("a", 1000): 90.0, ("b", 7): None}


def test_gap_and_frame_guard(spark):
    b = make(spark, [1.0, 2.0]).union(make(spark, [3.0], start=10 * 3600))
    assert [(r["after"], r["missing"]) for r in bars.gaps(b, 3600).collect()] == [(3600, 8)]
    w = frames.series()
    assert [r[0] for r in b.select(frames.rolled(F.max("high"), "high", 2, w)).collect()] == [None, None, 3.0]


def test_streak_zero_breaks_neither(spark):
    t = spark.createDataFrame([("s", i, i, i + 1, p, p) for i, p in enumerate([1.0, 0.0, 1.0, -1.0, 1.0])], "strategy string, trade_id int, entry_time int, exit_time int, net_pl double, r double")
    assert tuple(trades.streaks(t).first()) == ("s", 2, 1)
    assert tuple(trades.drawdown(t, 10.0).select("max_drawdown", "end_balance").first()) == (1.0, 12.0)


def test_bar_cache_and_manifest(spark, tmp_path):
    b = make(spark, [1.0, 2.0, 3.0])
    market.write_bars(b, str(tmp_path))
    assert market.read_bars(spark, str(tmp_path)).count() == 3
    bad = [p for p in (tmp_path / "manifest").iterdir() if p.name.startswith("part-") and p.stat().st_size][0]
    row = json.loads(bad.read_text())
    bad.write_text(json.dumps(row | {"bars": 4}))
    (tmp_path / "manifest" / f".{bad.name}.crc").unlink()
    with pytest.raises(ValueError):
        market.read_bars(spark, str(tmp_path))


def test_event_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "closed", "s", 7, 1.5, "tp")], market.LOG_SCHEMA)
    market.append_log(rows, str(tmp_path))
    part = next(p for p in tmp_path.rglob("part-*.json"))
    part.write_text(part.read_text() + "not json\n")
    part.with_name(f".{part.name}.crc").unlink()
    assert market.read_log(spark, str(tmp_path)).where("kind IS NOT NULL").count() == 1


def test_without_corpus_package(spark):
    import __spark_entry__ as e

    assert "bars_hourly" in e.queries() and "bars_hourly" in e.oracle_sql()


def test_divisions_by_zero_have_results(spark):
    """A balance of zero, strategies without a profit, constant results."""
    from barwright.operators import inference

    t = spark.createDataFrame([("s", i, i, i + 1, -1.0, -1.0) for i in range(5)], "strategy string, trade_id int, entry_time int, exit_time int, net_pl double, r double")
    assert tuple(trades.drawdown(t, 0.0).select("max_drawdown", "drawdown_pct").first()) == (5.0, 0.0)
    assert trades.composite(t).count() == 1
    assert inference.deflated_sharpe(inference.moments(t), 10, 0.1).first()["deflated"] == 0.0
    assert trades.rolling_factor(t).first()["tripwire"] is None


def test_drawdown_follows_exits(spark):
    # the trade that is entered first ends last: in order of exits the balance is 10, 13, 8; the tie doesn't renew the peak
    t = spark.createDataFrame([("s", 1, 0, 4 * 86_400, -5.0), ("s", 2, 86_400, 2 * 86_400, 3.0), ("s", 3, 86_400, 3 * 86_400, 0.0)], "strategy string, trade_id int, entry_time int, exit_time int, net_pl double")
    r = trades.drawdown(t, 10.0).first()
    assert (r["max_drawdown"], r["end_balance"], r["longest_days"]) == (5.0, 8.0, 2.0) and abs(r["drawdown_pct"] - 500 / 13) < 1e-9


def test_effective_trials_of_known_matrices(spark):
    from barwright.operators import inference

    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 3))
    same = spark.createDataFrame([(float(a), float(a), float(2 * a)) for a, *_ in x], "a double, b double, c double")
    apart = spark.createDataFrame(np.linalg.qr(x - x.mean(axis=0))[0].tolist(), "a double, b double, c double")
    assert abs(inference.effective_trials(same, ["a", "b", "c"]) - 1) < 1e-6
    assert abs(inference.effective_trials(apart, ["a", "b", "c"]) - 3) < 0.05


def test_day_that_is_open_gives_no_bias(spark):
    from barwright.operators import gates

    h = make(spark, [float(i % 7) for i in range(24 * 30)])
    before = gates.daily_bias(h, bars.coarser(h, 86_400, 19_800), 10).collect()
    assert all(r["day_time"] is None or r["day_time"] + 86_400 <= r["time"] for r in before)
    # what happens on a bar's own day doesn't change what it sees
    changed = make(spark, [float(i % 7) if i < 24 * 29 else 99.0 for i in range(24 * 30)])
    after = gates.daily_bias(changed, bars.coarser(changed, 86_400, 19_800), 10).collect()
    seen = lambda rows: {r["time"]: (r["day_time"], r["day_close"], r["bias"]) for r in rows if r["time"] < (24 * 30 - 6) * 3600}
    last = (24 * 29 * 3600 + 19_800) // 86_400 * 86_400 - 19_800 + 86_400  # the changed hours' first day ends here
    old, new = seen(before), seen(after)
    assert {t: v for t, v in old.items() if t < last} == {t: v for t, v in new.items() if t < last}


def test_structure_by_hand(spark):
    from barwright.operators import structure

    closes = [5, 6, 9, 6, 5, 6, 10, 11, 8, 7, 4, 7, 8, 3, 2]
    got = {r["time"] // 3600: (r["trend"], r["event"]) for r in structure.structure(make(spark, [float(c) for c in closes]), 2).collect()}
    # pivot high of bar 2 (10.0 with its wick) is known at bar 4 and passed by the close of bar 7
    assert got[6] == (-1, 0) and got[7] == (1, 2)
    # pivot low of bar 4 (4.0) is known at bar 6, that of bar 10 (3.0) at bar 12; bar 14 closes below it
    assert got[12][0] == 1 and got[13] == (1, 0) and got[14] == (-1, -2)


def test_folds_over_batches(spark):
    from barwright.operators import folds

    b = make(spark, [float(10 + (i * 7) % 11) for i in range(400)]).unionByName(make(spark, [float(10 + (i * 5) % 13) for i in range(300)], "b"))
    one = {(r["symbol"], r["time"]): r["sar"] for r in folds.parabolic_sar(b).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {(r["symbol"], r["time"]): r["sar"] for r in folds.parabolic_sar(b).collect()} == one and len(one) == 700
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

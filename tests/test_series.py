"""Block trees, ratchets, liquidity, ranks, excursions: hand cases, plain Python over all rows, and other chunk lengths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import blocks, chunkmaps, excursions, folds, frames, liquidity, ranks, ratchets

HOUR = 3600
BARS = "symbol string, time long, open double, high double, low double, close double, tick_volume long"


def walk(n, seed=1, symbol="a", step=1.0, gaps=True):
    rng, price, time, out = random.Random(seed), 100.0, 0, []
    for _ in range(n):
        o = price
        price = max(price + rng.gauss(0, step), 5.0)
        out.append((symbol, time, o, max(o, price) + abs(rng.gauss(0, step / 3)), min(o, price) - abs(rng.gauss(0, step / 3)), price, rng.randrange(1, 9)))
        time += HOUR * (rng.choice([1, 1, 1, 30]) if gaps else 1)
    return out


@pytest.fixture(scope="module")
def series(spark):
    rows = walk(700, 1, "a") + walk(90, 2, "b") + walk(1, 3, "c")
    return rows, spark.createDataFrame(rows, BARS)


def by_symbol(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_numbers_frames_and_sums(spark, series):
    rows, df = series
    x = blocks.numbered(df, span=7 * 86_400)
    got = {(r["symbol"], r["time"]): r["rn"] for r in x.collect()}
    assert got == {(s, r[1]): i for s, own in by_symbol(rows).items() for i, r in enumerate(own)}
    w = blocks.beside()
    y = blocks.framed(x, {"m": F.max("high").over(w.rowsBetween(-5, 2)), "n": F.count("high").over(w.rowsBetween(-5, 2))}, 5, 2, size=13)
    y = blocks.cumulated(y, {"total": F.col("tick_volume")}, size=11)
    found = {(r["symbol"], r["rn"]): (r["m"], r["n"], r["total"]) for r in y.collect()}
    for s, own in by_symbol(rows).items():
        for i in range(len(own)):
            part = own[max(i - 5, 0) : i + 3]
            assert found[s, i] == (max(r[3] for r in part), len(part), sum(r[6] for r in own[: i + 1]))


@pytest.mark.parametrize("fan", [6, 64])
def test_trees(spark, series, fan):
    rows, df = series
    x = blocks.numbered(df, span=7 * 86_400).checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else blocks.numbered(df, span=7 * 86_400)
    own, rng = by_symbol(rows), random.Random(fan)
    asks = [(k, s, rng.randrange(len(own[s])), rng.randrange(-2, len(own[s])), rng.uniform(60, 140)) for k, s in enumerate(rng.choices("abc", k=400))]
    q = spark.createDataFrame(asks, "id long, symbol string, a long, b long, level double")
    t = blocks.tree(x, F.col("high"), fan=fan)
    passed = {r["id"]: r["passed"] for r in blocks.first_passage(q, t, "a", F.col("level")).collect()}
    best = {r["id"]: (r["m"], r["m_rn"]) for r in blocks.extremes(q, t, "a", "b", "m").collect()}
    for k, s, a, b, level in asks:
        high = [r[3] for r in own[s]]
        assert passed[k] == next((i for i in range(a, len(high)) if high[i] > level), None)
        part = high[a : b + 1] if b >= a else []
        assert best[k] == ((max(part), a + part.index(max(part))) if part else (None, None))
    at = {(s, i): [lv for _, s2, a, b, lv in asks if s2 == s and a <= i <= b] for s, r in own.items() for i in range(len(r))}
    got = blocks.open_extremes(x, q, F.col("level"), "a", "b", "most", fan=max(fan, 3)).collect()
    assert {(r["symbol"], r["rn"]): r["most"] for r in got} == {k: max(v, default=None) for k, v in at.items()}


def test_placed(spark, series):
    rows, df = series
    times = sorted({r[1] + d for r in rows for d in (-1, 0, 1)})[::7]
    q = spark.createDataFrame([(s, t) for s in "abz" for t in times] + [("a", None)], "symbol string, t long")
    own = by_symbol(rows)
    got = {(r["symbol"], r["t"]): r["n"] for r in blocks.placed(q, df, "t", "n", span=5 * 86_400).collect()}
    assert got == {("a", None): None} | {(s, t): sum(r[1] < t for r in own.get(s, [])) for s in "abz" for t in times}


def plain_supertrend(own, period=10, m=3.0):
    """The definition, bar by bar."""
    out, atr, trs, u, low, d = [], 0.0, [], None, None, -1
    for i, (_, _, _, h, lo, c, _) in enumerate(own):
        c1 = own[i - 1][5] if i else None
        tr = h - lo if c1 is None else max(h - lo, abs(h - c1), abs(lo - c1))
        trs.append(tr)
        atr = 0.0 if i < period - 1 else sum(trs) / period if i == period - 1 else (atr * (period - 1) + tr) / period
        ub, lb = (h + lo) / 2 + m * atr, (h + lo) / 2 - m * atr
        if i:
            one = u == low
            u, low = ub if ub < u or c1 > u else u, lb if lb > low or c1 < low else low
            d = (-1 if c <= u else 1) if d < 0 or one else (1 if c >= low else -1)
        else:
            u, low = ub, lb
        out.append((u, low, d))
    return out


@pytest.mark.parametrize("size", [3, 17, 10_000])
def test_supertrend_in_any_chunks(spark, series, size):
    rows, df = series
    x = frames.candle_parts(blocks.numbered(df, span=7 * 86_400))
    got = {(r["symbol"], r["rn"]): (r["upper_band"], r["lower_band"], r["direction"]) for r in ratchets.supertrend(x, 7 * 86_400, size=size).collect()}
    for s, own in by_symbol(rows).items():
        for i, want in enumerate(plain_supertrend(own)):
            assert got[s, i] == pytest.approx(want, rel=1e-9)
    assert {v[2] for v in got.values()} == {1, -1}


def test_ratchet_maps_are_exact():
    """A chunk's map gives what walking it gives, for any value that comes in."""
    rng = np.random.default_rng(4)
    for inclusive in (True, False):
        for _ in range(60):
            n = int(rng.integers(1, 40))
            v, low, high = rng.integers(0, 12, n).astype(float), rng.integers(-4, 8, n).astype(float), rng.integers(4, 16, n).astype(float)
            m = ratchets._ends(v, low, high, inclusive)
            for y in np.arange(-5, 18, 0.5):
                assert ratchets._through(float(y), m, inclusive) == ratchets._walk(v, low, high, inclusive, float(y))[-1]


def test_qqe_in_any_chunks(spark, series):
    _, df = series
    x = blocks.numbered(df, span=7 * 86_400)
    cols = ["symbol", "rn", "rsi_ma", "longband", "shortband", "trend"]
    a, b = (sorted(map(tuple, ratchets.qqe(x, 7 * 86_400, size=s).select(*cols).collect())) for s in (5, 10_000))
    assert [r[:2] + r[5:] for r in a] == [r[:2] + r[5:] for r in b] and {r[5] for r in a} == {1, -1}
    assert np.allclose([r[2:5] for r in a], [r[2:5] for r in b])


def test_three_pivots_make_a_level_that_is_swept_once(spark):
    """Three highs of 110 within the band, then a bar that passes them."""
    highs = [101.0] * 80
    for i in (20, 32, 44):
        highs[i] = 110.0 + (i == 32) * 0.01
    highs[60], highs[75] = 112.0, 113.0
    rows = [("a", i * HOUR, 100.0, h, 99.0, 100.0, 1) for i, h in enumerate(highs)]
    df = spark.createDataFrame(rows, BARS)
    levels = [r for r in liquidity.swept_levels(liquidity.ranged(df, 86_400)).where("side > 0").collect()]
    third = next(r for r in levels if r["confirmed"] == 52)
    assert len([r for r in levels if r["confirmed"] < 52]) == 0 and third["swept"] == 60 and third["lower"] < 110.005 < third["upper"]
    got = {r["rn"]: r["buy_swept"] for r in liquidity.sweeps(df, 86_400).collect()}
    assert [i for i in range(75) if got[i]] == list(range(60, 72))


def test_sweeps_know_no_later_bar(spark):
    rows = walk(260, 9, gaps=False)
    late = [(*r[:2], 500.0, 900.0, 1.0, 500.0, 1) if i >= 200 else r for i, r in enumerate(rows)]
    one, two = ({r["rn"]: (r["buy_swept"], r["sell_swept"]) for r in liquidity.sweeps(spark.createDataFrame(x, BARS), 5 * 86_400).collect() if r["rn"] < 200} for x in (rows, late))
    assert one == two and any(map(any, one.values()))


def test_gap_boxes_by_hand(spark):
    """A rise over a gap of 2, filled by a close below it; two boxes open at once."""
    prices = [(100, 101, 99, 100), (100, 105, 100, 104), (104, 106, 103, 105), (105, 111, 105, 110), (110, 112, 108, 111), (111, 111, 107, 107.5), (107, 108, 102.5, 102.8), (102, 103, 100, 100.5)]
    df = spark.createDataFrame([("a", i * HOUR, *map(float, p), 1) for i, p in enumerate(prices)], BARS)
    found = sorted((r["created"], r["closed"], r["bottom"], r["top"]) for r in liquidity.boxes(liquidity.gaps(df, 86_400, 0.005)).where("side > 0").collect())
    assert found == [(2, 7, 101.0, 103.0), (4, 6, 106.0, 108.0)]
    got = [(r["bulls"], r["support"]) for r in liquidity.open_boxes(df, 86_400, 0.005).orderBy("rn").collect()]
    assert got == [(0, None), (0, None), (1, 103.0), (1, 103.0), (2, 108.0), (2, 108.0), (1, 103.0), (0, None)]


@pytest.mark.parametrize("n", [1, 7, 600, 1500])
def test_trailing_share(spark, n):
    rng = random.Random(n)
    rows = [(s, i, None if rng.random() < 0.05 else float(rng.randrange(50))) for s, size in (("a", 2600), ("b", n), ("c", n + 1)) for i in range(size)]
    got = {(r["symbol"], r["rn"]): r["share"] for r in ranks.trailing_share(spark.createDataFrame(rows, "symbol string, rn long, v double"), "v", n, "share").collect()}
    assert len(got) == len(rows)
    for s, own in by_symbol(rows).items():
        v = [r[2] for r in own]
        for i in range(0, len(v), 1 if n < 100 else 37):
            before = [x for x in v[max(i - n, 0) : i] if x is not None]
            want = sum(x < v[i] for x in before) / len(before) if i >= n and v[i] is not None and before else None
            assert got[s, i] == want


def test_spaced_in_any_chunks(spark):
    rng = random.Random(8)
    rows = [(k, at, at + rng.randrange(30)) for k in ("a", "b", None) for at in sorted(rng.sample(range(2000), 300))]
    df = spark.createDataFrame(rows, "key string, at long, until long")
    want = []
    for k in ("a", "b", None):
        free = None
        for _, at, until in (r for r in rows if r[0] == k):
            if free is None or at >= free:
                want.append((k, at))
                free = until + 2
    for size in (1, 10, 97, 10**6):
        assert sorted(((r["key"], r["at"]) for r in chunkmaps.spaced(df, ["key"], "at", "until", 2, size).collect()), key=str) == sorted(want, key=str)


def test_stop_and_reverse_turns():
    """A rise, then a bar below the level: the level jumps to the rise's extreme and falls from there."""
    level = folds.StopAndReverse(0.02, 0.02, 0.2)
    bars = [(10 + i, 9 + i) for i in range(10)] + [(15, 5), (6, 4), (5, 3), (30, 20), (31, 28)]
    got = [level.next(float(h), float(lo)) for h, lo in bars]
    assert got[0] is None and got[1] == got[2] == 9 and got[3] == pytest.approx(9 + 0.06 * (12 - 9)) and all(x <= lo for x, (_, lo) in zip(got[1:10], bars[1:10], strict=True))
    assert got[10] == 19  # the greatest high before the turn
    # the highs of the last two bars hold the falling level up
    assert got[11] == max(19 + 0.02 * (5 - 19), 19, 15) and got[12] < got[11] and level.side == 1 and got[13] == 3 and got[14] <= 20


def test_excursions_by_hand(spark):
    bars = [("m", 60 * i, h, lo) for i, (h, lo) in enumerate([(101, 99), (104, 98), (104, 97), (103, 90), (120, 80)])]
    b = spark.createDataFrame([(m, t, float(h), float(lo)) for m, t, h, lo in bars], "market string, time long, high double, low double")
    rows = [(1, "m", 60, 240, True, 100.0, 2.0), (2, "m", 61, 240, False, 100.0, 2.0), (3, "m", 0, None, True, 100.0, 2.0), (4, "m", 400, 500, True, 100.0, 2.0), (5, "x", 0, 100, True, 100.0, 2.0), (6, "m", 60, 61, True, 200.0, 0.0), (7, "m", 60, 61, True, 200.0, 5.0)]
    t = spark.createDataFrame(rows, "trade_id long, market string, entry_time long, exit_time long, is_buy boolean, entry_price double, risk double")
    got = {r["trade_id"]: (r["bars_held"], r["mfe_r"], r["mae_r"], r["minutes_to_mfe"]) for r in excursions.excursions(t, b, 120).collect()}
    assert got == {1: (3, 2.0, -5.0, 1), 2: (2, 5.0, -2.0, 2), 3: (0, 0.0, 0.0, 0), 4: (0, 0.0, 0.0, 0), 5: (0, 0.0, 0.0, 0), 6: (1, 0.0, 0.0, 0), 7: (1, 0.0, -20.4, 0)}


def test_views_hold_nothing_of_open_bars(spark):
    rows = walk(60, 5, gaps=False)
    ask = spark.createDataFrame([("a", t) for t in range(HOUR, 50 * HOUR, 1700)], "symbol string, t long")
    changed = [r if r[1] + HOUR <= 30 * HOUR else (*r[:2], 1.0, 2.0, 0.5, 1.5, 7) for r in rows]
    one, two = ({r["t"]: r["view"] for r in excursions.histories(ask, spark.createDataFrame(x, BARS), 6, HOUR, "t", 5 * HOUR).collect()} for x in (rows, changed))
    assert all(one[t] == two[t] for t in one if t <= 30 * HOUR)
    for t, view in one.items():
        closed = [r for r in rows if r[1] + HOUR <= t]
        if len(closed) < 5:
            assert view is None
        else:
            assert [tuple(v) for v in view] == [r[1:] for r in closed[-5:]] + [(t, *[closed[-1][5]] * 4, 0)]


def test_nearest_prior_keeps_the_lag(spark):
    left = spark.createDataFrame([(1, 100), (1, 199), (1, 200), (2, 50)], "user long, t long")
    right = spark.createDataFrame([(1, 100, "x"), (1, 90, "y"), (2, 60, "z")], "user long, s long, name string")
    got = {(r["user"], r["t"]): r["name"] for r in excursions.nearest_prior(left, right, ["name"], 100, 64, "t", "s", "user").collect()}
    assert got == {(1, 100): "x", (1, 199): "x", (1, 200): None, (2, 50): None}

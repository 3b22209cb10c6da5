"""The second rule library: no later bar matters, wrappers, and the registry."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from barwright.operators import library
from tests.test_series import BARS, HOUR, walk

DAY = 86_400


def fired(spark, rows, span=9 * DAY, wanted=None):
    s = library.rule_signals(spark.createDataFrame(rows, BARS), span, wanted)
    return {(r["symbol"], r["rn"], r["rule"]): r["signal"] for r in s.collect()}


def test_registry_is_whole():
    rows = library.candidates()
    assert len(rows) == 181 and rows[0]["id"] == "XV2-001" and rows[-1]["rule"] == "htf_pullback LATE" and rows[52]["stop"] == 1.1
    assert Counter(r["family"] for r in rows)["liquidity_sweep"] == 18 and sum(r["once"] for r in rows) == 15 + 4 + 13 + 21 + 14
    names = {r["rule"].split()[0] for r in rows}
    assert len(names) == 42 and all(callable(getattr(library, n)) for n in names)


def test_no_later_bar_matters_nor_do_spans(spark):
    rows = walk(620, 21, step=1.5, gaps=False)
    later = [(*r[:2], 400.0, 600.0, 200.0, 500.0, 50) if i >= 560 else r for i, r in enumerate(rows)]
    one, two, three = fired(spark, rows), fired(spark, later), fired(spark, rows, 3 * DAY)
    assert one == three
    before = lambda x: {k: v for k, v in x.items() if k[1] < 560}
    assert before(one) == before(two) and len({k[2] for k in one}) > 80


def test_a_rule_alone_fires_as_among_all(spark):
    rows = walk(300, 4, gaps=False)
    every = fired(spark, rows)
    for rule in ("three_push 6", "range_break ASIA LONDON", "momentum_divergence 20", "orb_failure LATE 4"):
        assert fired(spark, rows, wanted=[rule]) == {k: v for k, v in every.items() if k[2] == rule}


def test_three_pushes_by_hand(spark):
    """Three rising highs of six bars, then a close below the low before."""
    closes = [100 + i * 0.5 for i in range(30)] + [110.0]
    rows = [("a", i * HOUR, c, c + 0.2, c - 0.2, c, 1) for i, c in enumerate(closes)]
    got = fired(spark, rows, wanted=["three_push 6"])
    assert got == {("a", 30, "three_push 6"): -1}


def test_wrappers(spark):
    """One signal of a session for the one kind, four bars apart for the other; the wrong side doesn't take a slot."""
    first = 22 * HOUR  # 3:30 IST, in Asia
    rows = [("a", first + k * HOUR, k, float(3.5 + k), 0, 0, 0, 0, 0, 0, r, s) for k, (r, s) in enumerate([("x", 1), ("x", -1), ("x", -1), ("x", -1), ("x", -1), ("x", -1)])]
    outs = ", ".join(f"out_{s.lower()} int" for s in library.STOPS)
    sig = spark.createDataFrame(rows, f"symbol string, time long, rn int, ist_hour double, {outs}, rule string, signal int")
    listed = [{"id": i, "rule": "x", "session": "ASIA", "side": side, "once": once} for i, side, once in (("o", "both", True), ("s", "short", True), ("c", "both", False), ("d", "short", False))]
    got = sorted((r["id"], r["rn"]) for r in library.candidate_signals(sig, listed).collect())
    assert got == [("c", 0), ("c", 4), ("d", 1), ("d", 5), ("o", 0), ("s", 1)]


@pytest.mark.parametrize("hours", [0, 1])
def test_short_series(spark, hours):
    assert fired(spark, walk(hours, 1)) == {} and library.candidate_signals(library.rule_signals(spark.createDataFrame(walk(hours, 1), BARS), DAY), library.candidates()).where(F.lit(True)).count() == 0

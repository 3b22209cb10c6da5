"""Calendars, report files, and statistics against known values."""

import json
import math

import pytest
from pyspark.sql import functions as F

from barwright.operators import inference
from barwright.sources import news, reports


def test_calendar_files(spark, tmp_path):
    base = {"2024-01-01": [{"name": "A", "utc_time": "12:30"}, {"name": "B", "utc_time": "9:05"}], "bad": [{"name": "C", "utc_time": "10:00"}], "2024-01-02": [{"name": "D", "utc_time": "25:00"}, {"utc_time": "11:00"}]}
    over = {"2024-01-01": [{"name": "X", "utc_time": "12:30"}, {"name": "Y", "utc_time": "23:58"}, {"name": "Z", "utc_time": "23:58"}], "2024-01-03": [{"name": "V", "utc_time": "00:02"}]}
    for name, x in (("base", base), ("over", over)):
        (tmp_path / f"{name}.json").write_text(json.dumps(x, indent=1))
    (tmp_path / "broken.json").write_text("{not json")
    read = lambda n: news.read_calendar(spark, f"file://{tmp_path}/{n}.json", whole=True)
    events = news.scheduled(news.merged(read("base"), read("over")))
    day = 19_723 * 86_400  # 2024-01-01
    assert sorted((r["name"], r["due"] - day) for r in events.collect()) == [("A", 45_000), ("B", 32_700), ("V", 2 * 86_400 + 120), ("Y", 86_280), ("Z", 86_280)]
    assert read("broken").count() == 0
    points = spark.createDataFrame([(day + s,) for s in (45_000, 44_100, 44_099, 86_399, 86_400 + 780, 86_400 + 781, 3 * 86_400 - 86_400 - 700)], "t long")
    got = {r["t"] - day: (r["name"], r["minutes_off"], r["direction"]) for r in news.blackout(points, events, "t").collect()}
    assert got == {45_000: ("A", 0, "after"), 44_100: ("A", 15, "before"), 44_099: (None, None, None), 86_399: ("Y", 2, "after"), 87_180: ("Y", 15, "after"), 87_181: (None, None, None), 172_100: ("V", 14, "before")}
    ahead = [(r["name"], r["minutes_away"], r["nth"]) for r in news.upcoming(points.where(F.col("t") == day + 44_100), events, "t", 12).orderBy("nth").collect()]
    assert ahead == [("A", 15, 1), ("Y", 703, 2), ("Z", 703, 3)]


def test_series_of_tuples(spark, tmp_path):
    (tmp_path / "one.json").write_text("[[10, 20, 5.0, 2.5],\n [30, -1.0, 2.0], [1, 2, 3], [5, 6, 7, 0], [1]]")
    got = sorted(map(tuple, reports.read_series(spark, f"file://{tmp_path}/one.json", whole=True).collect()))
    assert got == [(1, 1, 2.0, 3.0, 2.0 / 3), (10, 20, 5.0, 2.5, 2.0), (30, 30, -1.0, 2.0, -0.5)]
    (tmp_path / "lines.json").write_text("[1, 2, 3.0, 4.0]\n\nnothing\n[[7, 8.0, 2.0]]\n")
    assert sorted(r["entry_time"] for r in reports.read_series(spark, f"file://{tmp_path}/lines.json").collect()) == [1, 7]


def test_a_run_replaces_its_partition_alone(spark, tmp_path):
    cols = "trade_id long, is_buy boolean, entry_time long, exit_time long, entry_price double, exit_price double, net_pl double, strategy string, exit_reason string"
    rows = [(1, True, 0, 600, 10.0, 10.5, 5.0, "s", "tp"), (2, False, 60, 120, 10.0, 10.25, -2.5, "s", None), (3, False, 60, 120, 10.0, 10.25, 0.0, "s", "x")]
    t, path = spark.createDataFrame(rows, cols), f"file://{tmp_path}/report"
    reports.write_trades(reports.derived(t), path, "a")
    reports.write_trades(reports.derived(t.where("trade_id = 1")), path, "b")
    reports.write_trades(reports.derived(t.where("trade_id < 3")), path, "a")
    got = {(r["run"], r["trade_id"]): (r["pips"], r["trade_result"], r["return_r"], r["duration_minutes"], r["entry_datetime"]) for r in reports.read_trades(spark, path).collect()}
    assert got == {("a", 1): (50.0, "WIN", 1.0, 10.0, "1970-01-01 00:00:00"), ("a", 2): (-25.0, "LOSS", -1.0, 1.0, "1970-01-01 00:01:00"), ("b", 1): (50.0, "WIN", 1.0, 10.0, "1970-01-01 00:00:00")}
    reports.write_manifest(t, f"{path}-m", "a", {"k": "v"})
    reports.write_manifest(t.where("trade_id = 1"), f"{path}-m", "b", {})
    assert reports.latest(reports.read_manifests(spark, f"{path}-m")).first()["run"] == "b"


def test_students_tail(spark):
    known = [(1.0, 1, 0.25), (0.0, 7, 0.5), (-0.5, 3, 0.674276017575924), (12.706204736432095, 1, 0.025), (2.2281388519649385, 10, 0.025), (63.65674116287, 1, 0.005), (3.169272672616951, 10, 0.005)]
    df = spark.createDataFrame([(t, v) for t, v, _ in known], "t double, v long")
    got = {(r["t"], r["v"]): r["p"] for r in df.select("t", "v", inference.student_tail(F.col("t"), F.col("v")).alias("p")).collect()}
    assert all(got[t, v] == pytest.approx(p, rel=1e-9) for t, v, p in known)
    z = spark.range(1, 60).select((F.col("id") / 3.0).alias("z")).select("z", inference.log_gamma(F.col("z")).alias("g")).collect()
    assert all(r["g"] == pytest.approx(math.lgamma(r["z"]), abs=1e-11) for r in z)


def test_bootstrap_resamples(spark):
    """Counts are Poisson: a simulation's size and mean vary as those of a resample, and no two simulations share draws."""
    n, sims = 1024, 400
    rows = [(k, "s", math.sin(k) + 0.1) for k in range(n)]
    df = spark.createDataFrame(rows, "trade_id long, strategy string, net_pl double").repartition(3)
    got = [r["expectancy"] for r in inference.bootstrap(df, sims).collect()]
    mean = sum(p for _, _, p in rows) / n
    sd = math.sqrt(sum((p - mean) ** 2 for _, _, p in rows) / n / n)
    spread = math.sqrt(sum((g - mean) ** 2 for g in got) / sims)
    assert len(got) == len(set(got)) == sims and abs(sum(got) / sims - mean) < 4 * sd / math.sqrt(sims) and 0.85 < spread / sd < 1.15


def test_mean_tests_of_few_and_constant_results(spark):
    rows = [("few", 1.0)] * 9 + [("same", 2.0)] * 20 + [("some", float(k % 3)) for k in range(30)]
    got = {r["strategy"]: r for r in inference.mean_tests(spark.createDataFrame(rows, "strategy string, r double"), 10**9).collect()}
    assert got["few"]["p"] is None and got["same"]["corrected"] is None and 0 < got["some"]["p"] < 1e-6 and got["some"]["corrected"] <= 1

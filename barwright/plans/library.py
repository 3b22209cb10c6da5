"""The second rule library's queries. Their SQL has its own levels (windows, counting, as-of joins) and its own conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import library
from barwright.plans.market import _ALL, _recursive, hourly, query

SPAN = 5 * 86_400
_W = "PARTITION BY symbol ORDER BY bn"
_IN = {"asia": "hr >= 2.5 AND hr < 11.5", "london": "hr >= 11.5 AND hr < 15.5", "overlap": "hr >= 15.5 AND hr < 17.5", "ny": "hr >= 17.5 AND hr < 21.5", "late": "hr >= 21.5 OR hr < 2.0", "day_session": "hr >= 11.5 AND hr < 21.5", "overnight": "hr >= 21.5 OR hr < 11.5"}
_LASTS, _RUNS = ("asia", "london", "late", "overnight", "day_session"), ("asia", "london", "ny", "late", "overlap")


def _occurrences(s: str) -> str:
    return f"""oc_{s} AS (SELECT symbol, k_{s} AS k, max(high) AS hi, min(low) AS lo, arg_min(open, bn) AS op, arg_max(close, bn) AS cl, max(high) - min(low) AS width FROM x2 WHERE in_{s} GROUP BY 1, 2),
of_{s} AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY k) AS m FROM (SELECT *, width IS DISTINCT FROM lag(width) OVER (PARTITION BY symbol ORDER BY k) AS fresh FROM oc_{s})),
op_{s} AS (SELECT a.*, (SELECT CASE WHEN count(*) >= 5 THEN avg(CASE WHEN b.width < a.width THEN 1.0 ELSE 0.0 END) END FROM of_{s} b WHERE b.symbol = a.symbol AND b.fresh AND b.m BETWEEN a.m - 20 AND a.m - 1) AS pct FROM of_{s} a)"""


def _run(s: str) -> str:
    w = f"(PARTITION BY x3.symbol, in_{s}, k_{s} ORDER BY x3.bn ROWS UNBOUNDED PRECEDING)"
    first = {"asia": (2, 4), "london": (2, 4), "ny": (2, 4), "late": (2, 4), "overlap": (2,)}[s]
    seen = f"count(*) OVER {w}"
    out = [f"CASE WHEN in_{s} THEN {f} OVER {w} END AS r{c}_{s}" for c, f in (("h", "max(high)"), ("l", "min(low)"), ("o", "first_value(open)"), ("n", "count(*)"))]
    out.append(f"CASE WHEN in_{s} THEN sum(close * tick_volume) OVER {w} / nullif(sum(tick_volume) OVER {w}, 0) END AS rv_{s}")
    for k in first:  # the first k bars, from the k-th on
        out += [f"CASE WHEN in_{s} AND {seen} >= {k} THEN {f}(CASE WHEN pos_{s} <= {k} THEN {c} END) OVER {w} END AS f{k}{c[0]}_{s}" for f, c in (("max", "high"), ("min", "low"))]
    return ", ".join(out)


def _held(f: str, n: int) -> str:
    frame = f"({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({f[f.index('(') + 1 : -1]}) OVER {frame} = {n} THEN {f} OVER {frame} END"


_LAGS = {"close": (1, 2, 4, 8), "high": (1, 2, 3, 4), "low": (1, 2, 3, 4), "open": (2,), "atr14": (1, 2, 12), "range": (1,), "hh20": (1, 20), "ll20": (1, 20), "hh12": (12,), "ll12": (12,), "hh6": (6, 12), "ll6": (6, 12), "rn7": (1,), "rn4": (1,), "sq": (1,), "up20": (1,), "dn20": (1,)}
_LAGS |= {f"r{c}_{s}": (1,) for s in ("asia", "london", "late", "ny") for c in "hl"}
_FLAGS = {"ba": ("close > h_asia", "close < l_asia")} | {f"t{s}": (f"close > f4h_{s}", f"close < f4l_{s}") for s in ("london", "asia")} | {f"w{s}": (f"high > f4h_{s}", f"low < f4l_{s}") for s in ("asia", "london", "ny", "late")}
_LIB = f"""{_ALL}, {_recursive("e800", "close", 800, 2 / 801, "ind")},
x0 AS (SELECT ind.*, e800_r.y AS ema800, ((ind.time + 19800) % 86400) / 3600.0 AS hr, CAST(floor((ind.time + 19800) / 86400) AS BIGINT) AS dy, CAST(floor((ind.time + 19800) / 604800) AS BIGINT) AS wk, row_number() OVER (PARTITION BY ind.symbol ORDER BY ind.time) - 1 AS bn FROM ind LEFT JOIN e800_r ON e800_r.symbol = ind.symbol AND e800_r.time = ind.time),
x1 AS (SELECT *, {", ".join(f"{c} AS in_{s}" for s, c in _IN.items())} FROM x0),
x2 AS (SELECT *, {", ".join(f"CAST(sum(CASE WHEN in_{s} THEN 0 ELSE 1 END) OVER ({_W}) AS BIGINT) AS k_{s}" for s in _IN)} FROM x1),
{", ".join(_occurrences(s) for s in _LASTS)},
dd AS (SELECT symbol, dy, arg_min(open, bn) AS op, max(high) AS hi, min(low) AS lo, arg_max(close, bn) AS cl FROM x2 GROUP BY 1, 2),
de AS (SELECT symbol, dy, op AS d_open, lag(op) OVER w AS p_op, lag(hi) OVER w AS p_hi, lag(lo) OVER w AS p_lo, lag(cl) OVER w AS p_cl, CASE WHEN row_number() OVER w > 14 THEN avg(hi - lo) OVER (PARTITION BY symbol ORDER BY dy ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS band FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY dy)),
wd AS (SELECT symbol, wk, lag(max(high)) OVER w AS w_hi, lag(min(low)) OVER w AS w_lo FROM x2 GROUP BY 1, 2 WINDOW w AS (PARTITION BY symbol ORDER BY wk)),
x3 AS (SELECT x2.*, d_open, p_op, p_hi, p_lo, p_cl, band, w_hi, w_lo, {", ".join(f"o_{s}.hi AS h_{s}, o_{s}.lo AS l_{s}, o_{s}.op AS op_{s}, o_{s}.cl AS cl_{s}, o_{s}.width AS wd_{s}, o_{s}.pct AS pc_{s}" for s in _LASTS)}, {", ".join(f"row_number() OVER (PARTITION BY x2.symbol, in_{s}, k_{s} ORDER BY x2.bn) AS pos_{s}" for s in _RUNS)},
CASE WHEN count(*) OVER sl >= 10 THEN avg(true_range) OVER sl END AS norm
FROM x2 JOIN de ON de.symbol = x2.symbol AND de.dy = x2.dy JOIN wd ON wd.symbol = x2.symbol AND wd.wk = x2.wk {" ".join(f"ASOF LEFT JOIN op_{s} o_{s} ON o_{s}.symbol = x2.symbol AND x2.k_{s} > o_{s}.k" for s in _LASTS)}
WINDOW sl AS (PARTITION BY x2.symbol, x2.time % 86400 ORDER BY x2.time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
x4 AS (SELECT *, {", ".join(_run(s) for s in _RUNS)}, {", ".join(f"{_held('max(high)', n)} AS hh{n}, {_held('min(low)', n)} AS ll{n}" for n in (6, 8, 12, 20, 24))},
{_held("avg(close)", 20)} AS m20, {_held("stddev_pop(close)", 20)} AS s20, {_held("max(rsi14)", 20)} AS rx, {_held("min(rsi14)", 20)} AS rm, {_held("min(range)", 7)} AS rn7, {_held("min(range)", 4)} AS rn4, {_held("avg(tick_volume)", 50)} AS v50, CASE WHEN true_range < 0.6 * norm THEN 1.0 ELSE 0.0 END AS calm FROM x3),
x5 AS (SELECT *, 2 * s20 < 1.5 * atr14 AS sq, close > hh20 AS up20, close < ll20 AS dn20, {", ".join(f"{a} AS {n}u, {b} AS {n}d" for n, (a, b) in _FLAGS.items())}, {_held("avg(calm)", 8)} AS calm8, coalesce(hh24 - ll24, 0.0) AS w24 FROM x4),
x6 AS (SELECT *, {_held("avg(w24)", 200)} AS w200, {", ".join(f"lag({c}, {n}) OVER ({_W}) AS {c}_{n}" for c, ns in _LAGS.items() for n in ns)}, {", ".join(f"lag({n}{x}) OVER ({_W}) AS {n}{x}_1" for n in _FLAGS for x in "ud")} FROM x5)"""

_LW, _UW = "lower_wick / range > ", "upper_wick / range > "


def _i(s: str) -> str:
    return f"({_IN[s.lower()]})"


def _break(s, t, lo=0.0, hi=1.0, width=99.0, atr=0.0, k=0.0):
    s, buf = s.lower(), f"({atr} * atr14 + {k} * band)" if k else f"{atr} * atr14"
    gate = f"{_i(t)} AND (band IS NULL OR coalesce(wd_{s} <= {width} * band, false)) AND (pc_{s} IS NULL OR (pc_{s} >= {lo} AND pc_{s} <= {hi}))"
    return f"{gate} AND close - h_{s} > {buf}", f"{gate} AND l_{s} - close > {buf}"


def _fade(move, k, t):
    return f"{_i(t)} AND {move} < -{k} * band AND {move} < 0", f"{_i(t)} AND {move} > {k} * band AND {move} > 0"


def _first(s, n, k=0.0):
    s = s.lower()
    buf = f"(0.0 * atr14 + {k} * band)" if k else "0.0 * atr14"
    return f"close > f{n}h_{s} + {buf}", f"close < f{n}l_{s} - {buf}"


def _sweep(hi, lo):
    return f"low < {lo} AND close > {lo} AND {_LW} 0.3", f"high > {hi} AND close < {hi} AND {_UW} 0.3"


def _swap(pair, mode):
    return pair[::-1] if mode == "fade" else pair


def _anchored(anchor, k, s):
    a = {"day_open": "d_open", "prev_close": "p_cl", "session_open": f"ro_{s.lower()}"}[anchor]
    return f"{_i(s)} AND close > {a} + {k} * band", f"{_i(s)} AND close < {a} - {k} * band"


def _gap_score(side):
    gap, body, trend, place = ("low_1 - high_3", "close_2 - open_2", "close > ema200", "close < ema800") if side > 0 else ("low_3 - high_1", "open_2 - close_2", "close < ema200", "close > ema800")
    return f"CASE WHEN atr14_2 IS NULL THEN -1 ELSE 30 * least(greatest(0.0, {gap}) / greatest(1e-9, atr14_2), 1) + 30 * least(greatest(0.0, {body}) / greatest(1e-9, high_2 - low_2), 1) + CASE WHEN {trend} THEN 20 ELSE 0 END + 10 + CASE WHEN {place} THEN 10 ELSE 0 END END"


def _move(n, unit, k):
    return f"({unit} IS NOT NULL AND close - close_{n} < -{k} * greatest({unit}, 1e-9))", f"({unit} IS NOT NULL AND close - close_{n} > {k} * greatest({unit}, 1e-9))"


_GAPS = ("high_3 < low_1 AND low <= low_1 AND close > high_3", "low_3 > high_1 AND high >= high_1 AND close < low_3")
_BOTH = _sweep("p_hi", "p_lo")
_RULES = {
    "range_break": lambda s, t, pct_lo=0.0, pct_hi=1.0, max_width_band=99.0, buffer_atr=0.0, noise_band_k=0.0: _break(s, t, pct_lo, pct_hi, max_width_band, buffer_atr, noise_band_k),
    "range_break_retest": lambda s, t: (f"{_i(t)} AND bau_1 AND low <= h_asia AND close > h_asia", f"{_i(t)} AND bad_1 AND high >= l_asia AND close < l_asia"),
    "range_break_failure": lambda s, t: (f"{_i(t)} AND l_{s.lower()} > low AND close > greatest(open, l_{s.lower()})", f"{_i(t)} AND h_{s.lower()} < high AND close < least(open, h_{s.lower()})"),
    "session_move_fade": lambda s, t, k: _fade(f"(cl_{s.lower()} - op_{s.lower()})", k, t),
    "close_position_fade": lambda s, t: (f"{_i(t)} AND (cl_{s.lower()} - l_{s.lower()}) / greatest(h_{s.lower()} - l_{s.lower()}, 1e-9) <= 0.2", f"{_i(t)} AND (cl_{s.lower()} - l_{s.lower()}) / greatest(h_{s.lower()} - l_{s.lower()}, 1e-9) >= 0.8"),
    "prev_day_return_fade": lambda t, k: _fade("(p_cl - p_op)", k, t),
    "gap_fade": lambda t, k: _fade("(d_open - p_cl)", k, t),
    "orb": lambda s, n, noise_band_k=0.0: _first(s, n, noise_band_k),
    "orb_failure": lambda s, n: (f"w{s.lower()}d_1 AND close > greatest(open, f{n}l_{s.lower()}) AND f{n}l_{s.lower()} IS NOT NULL", f"w{s.lower()}u_1 AND close < least(open, f{n}h_{s.lower()}) AND f{n}h_{s.lower()} IS NOT NULL"),
    "orb_retest": lambda s, n: (f"t{s.lower()}u_1 AND low <= f{n}h_{s.lower()} AND close > f{n}h_{s.lower()}", f"t{s.lower()}d_1 AND high >= f{n}l_{s.lower()} AND close < f{n}l_{s.lower()}"),
    "level_sweep_reclaim": lambda v: {"pdh_pdl": _BOTH, "pwh_pwl": _sweep("w_hi", "w_lo"), "asia": _sweep("h_asia", "l_asia"), "late": _sweep("h_late", "l_late")}[v],
    "daily_bias_sweep": lambda: (f"{_BOTH[0]} AND NOT coalesce({_BOTH[1]}, false) AND p_cl > p_op", f"{_BOTH[1]} AND p_cl < p_op"),
    "round_sweep": lambda q: tuple(f"abs(close - round_even(close / {q}, 0) * {q}) < 0.25 * atr14 AND {c}" for c in _sweep(f"round_even(close / {q}, 0) * {q}", f"round_even(close / {q}, 0) * {q}")),
    "round_break": lambda q: (f"close_1 < round_even(close / {q}, 0) * {q} AND close > round_even(close / {q}, 0) * {q} + 0.2 * atr14", f"close_1 > round_even(close / {q}, 0) * {q} AND close < round_even(close / {q}, 0) * {q} - 0.2 * atr14"),
    "equal_extremes_sweep": lambda: ("abs(ll20 - ll20_20) < 0.15 * atr14 AND low < ll20 AND close > ll20", "abs(hh20 - hh20_20) < 0.15 * atr14 AND high > hh20 AND close < hh20"),
    "session_extreme_sweep": lambda s, min_bars=8: (f"rn_{s.lower()} >= {min_bars} AND low < rl_{s.lower()}_1 AND close > rl_{s.lower()}_1 AND {_LW} 0.4", f"rn_{s.lower()} >= {min_bars} AND high > rh_{s.lower()}_1 AND close < rh_{s.lower()}_1 AND {_UW} 0.4"),
    "session_extreme_rejection": lambda s, min_bars=6: (f"rn_{s.lower()} >= {min_bars} AND low <= rl_{s.lower()}_1 AND {_LW} 0.5", f"rn_{s.lower()} >= {min_bars} AND high >= rh_{s.lower()}_1 AND {_UW} 0.5"),
    "noise_band_break": _anchored,
    "noise_band_fade": lambda a, k, s: _anchored(a, k, s)[::-1],
    "tod_spike": lambda k, mode: _swap((f"true_range > {k} * norm AND close > open", f"true_range > {k} * norm AND close < open"), mode),
    "tod_quiet_break": lambda n, k: ("calm8 >= 0.99 AND close > hh8", "calm8 >= 0.99 AND close < ll8"),
    "tod_relative_move": lambda n, k, mode: _swap(_move(n, "norm", k)[::-1], mode),
    "extension_exhaustion": lambda n, k: (f"{_move(n, 'atr14', k)[0]} AND {_LW} 0.35", f"{_move(n, 'atr14', k)[1]} AND {_UW} 0.35"),
    "bos_retest": lambda n: ("up20_1 AND low <= hh20_1 AND close > hh20_1", "dn20_1 AND high >= ll20_1 AND close < ll20_1"),
    "choch": lambda n: ("hh12 < hh12_12 AND ll12 < ll12_12 AND close > hh12", "hh12 > hh12_12 AND ll12 > ll12_12 AND close < ll12"),
    "displacement": lambda k, mode: _swap(tuple(f"abs(close - open) > {k} * atr14 AND abs(close - open) / range > 0.6 AND close {c} open" for c in "><"), mode),
    "fvg_entry": lambda mode: _swap(_GAPS, mode),
    "fvg_scored_entry": lambda least: (f"{_GAPS[0]} AND {_gap_score(1)} >= {least}", f"{_GAPS[1]} AND {_gap_score(-1)} >= {least}"),
    "inside_break": lambda n: tuple(" AND ".join([f"high_{j} < high_{n + 1} AND low_{j} > low_{n + 1}" for j in range(1, n + 1)] + [c]) for c in (f"close > high_{n + 1}", f"close < low_{n + 1}")),
    "nr_break": lambda n: (f"range_1 <= rn{n}_1 AND close > high_1", f"range_1 <= rn{n}_1 AND close < low_1"),
    "squeeze": lambda mode: _swap(("sq_1 AND close > m20 + 2 * s20", "sq_1 AND close < m20 - 2 * s20"), mode),
    "range_pct_break": lambda n, q: (f"hh24 - ll24 < {2 * q} * w200 AND close > hh24", f"hh24 - ll24 < {2 * q} * w200 AND close < ll24"),
    "coil_expand": lambda n: tuple(f"atr14 < atr14_12 AND range > 2 * atr14_1 AND close {c} open" for c in "><"),
    "momentum_divergence": lambda n: ("low < ll20 AND rsi14 > rm", "high > hh20 AND rsi14 < rx"),
    "volume_climax": lambda k: (f"tick_volume > {k} * v50 AND {_LW} 0.4", f"tick_volume > {k} * v50 AND {_UW} 0.4"),
    "three_push": lambda n: ("ll6 < ll6_6 AND ll6_6 < ll6_12 AND close > high_1", "hh6 > hh6_6 AND hh6_6 > hh6_12 AND close < low_1"),
    "session_open_revert": lambda s, k: tuple(f"rn_{s.lower()} >= 4 AND atr14 IS NOT NULL AND {c} > {k} * greatest(atr14, 1e-9)" for c in (f"ro_{s.lower()} - close", f"close - ro_{s.lower()}")),
    "session_vwap_revert": lambda s, k: tuple(f"atr14 IS NOT NULL AND {c} > {k} * greatest(atr14, 1e-9)" for c in (f"rv_{s.lower()} - close", f"close - rv_{s.lower()}")),
    "bb_fade": lambda n, k: (f"low < m20 - {k} * s20 AND close > m20 - {k} * s20", f"high > m20 + {k} * s20 AND close < m20 + {k} * s20"),
    "prev_close_retest": lambda k: tuple(f"abs(close - p_cl) < {k} * atr14 AND abs(close_4 - p_cl) > {4 * k} * atr14 AND close_4 {c} p_cl" for c in "<>"),
    "weekly_bias_break": lambda s: (f"{_i(s)} AND 2 * close > w_hi + w_lo AND close > hh20", f"{_i(s)} AND NOT coalesce(2 * close > w_hi + w_lo, false) AND close < ll20"),
    "htf_pullback": lambda s: (f"rn_{s.lower()} >= 4 AND p_cl > p_op AND close_1 < ro_{s.lower()} AND close > ro_{s.lower()}", f"rn_{s.lower()} >= 4 AND p_cl < p_op AND close_1 > ro_{s.lower()} AND close < ro_{s.lower()}"),
}


def _conditions(rule: str) -> tuple[str, str]:
    name, *words = rule.split()
    number = lambda v: float(v) if "." in v else int(v) if v.isdigit() else v
    named = {w.split("=")[0]: number(w.split("=")[1]) for w in words if "=" in w}
    side = named.pop("side", None)
    long, short = _RULES[name](*[number(w) for w in words if "=" not in w], **named)
    return ("false" if side == "short" else long), ("false" if side == "long" else short)


_LISTED = library.candidates()
_NAMES = list(dict.fromkeys(c["rule"] for c in _LISTED))
_FIRED = "lr AS (" + " UNION ALL ".join(f"SELECT symbol, time, bn, {k} AS rule, CASE WHEN coalesce({_conditions(r)[1]}, false) THEN -1 WHEN coalesce({_conditions(r)[0]}, false) THEN 1 ELSE 0 END AS signal FROM x6" for k, r in enumerate(_NAMES)) + ")"
_CANDIDATES = "lc(id, rule, session, side, once) AS (VALUES " + ", ".join(f"('{c['id']}', {_NAMES.index(c['rule'])}, '{c['session'].lower()}', {dict(long=1, short=-1, both=0)[c['side']]}, {str(c['once']).lower()})" for c in _LISTED) + ")"
_IS = "CASE session " + " ".join(f"WHEN '{s}' THEN in_{s}" for s in _IN) + " END"
_OC = "CASE session " + " ".join(f"WHEN '{s}' THEN k_{s}" for s in _IN) + " END"
_WRAPPED = f"""{_CANDIDATES}, lj AS (SELECT r.symbol, r.time, r.bn, c.id, c.once, r.signal, {_IS} AS ins, {_OC} AS occ FROM lr r JOIN lc c ON c.rule = r.rule JOIN x2 ON x2.symbol = r.symbol AND x2.bn = r.bn WHERE r.signal <> 0 AND c.side IN (0, r.signal)),
l1 AS (SELECT symbol, time, id, signal FROM lj WHERE once AND ins QUALIFY row_number() OVER (PARTITION BY symbol, id, occ ORDER BY bn) = 1),
l2 AS (SELECT *, min(bn) OVER (PARTITION BY symbol, id ORDER BY bn RANGE BETWEEN 4 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, row_number() OVER (PARTITION BY symbol, id ORDER BY bn) AS k FROM lj WHERE NOT once),
l3 AS (SELECT symbol, time, bn, id, signal, nxt FROM l2 WHERE k = 1 UNION ALL SELECT n.symbol, n.time, n.bn, n.id, n.signal, n.nxt FROM l3 JOIN l2 n ON n.symbol = l3.symbol AND n.id = l3.id AND n.bn = l3.nxt)"""


@query("library_rule_signals", f"WITH {_LIB}, {_FIRED}, names(rule, name) AS (VALUES {', '.join(f'({k}, {r!r})' for k, r in enumerate(_NAMES))}) SELECT symbol, time, name AS rule, CAST(signal AS BIGINT) AS signal FROM lr JOIN names USING (rule) WHERE signal <> 0", "hours", "candles")
def _(spark, d):
    return library.rule_signals(hourly(spark, d), SPAN).select("symbol", "time", "rule", "signal")


@query("library_candidate_signals", f"WITH {_LIB}, {_FIRED}, {_WRAPPED} SELECT symbol, time, id, CAST(signal AS BIGINT) AS signal FROM l1 UNION ALL SELECT symbol, time, id, CAST(signal AS BIGINT) FROM l3", "hours", "candles")
def _(spark, d):
    return library.candidate_signals(library.rule_signals(hourly(spark, d), SPAN), _LISTED).select("symbol", "time", "id", "signal")


@query("library_families", f"WITH {_LIB}, {_FIRED}, {_WRAPPED}, lf(id, family) AS (VALUES {', '.join(repr((c['id'], c['family'])) for c in _LISTED)}), la AS (SELECT symbol, time, id, signal FROM l1 UNION ALL SELECT symbol, time, id, signal FROM l3) SELECT family, count(DISTINCT id) AS candidates, count(*) AS signals, count(*) FILTER (signal > 0) AS longs, count(DISTINCT symbol || time) AS bars FROM la JOIN lf USING (id) GROUP BY 1", "hours", "candles")
def _(spark, d):
    s = library.candidate_signals(library.rule_signals(hourly(spark, d), SPAN), _LISTED)
    families = spark.createDataFrame([(c["id"], c["family"]) for c in _LISTED], "id string, family string")
    return s.join(F.broadcast(families), "id").groupBy("family").agg(F.count_distinct("id").alias("candidates"), F.count(F.lit(1)).alias("signals"), F.count_if(F.col("signal") > 0).alias("longs"), F.count_distinct("symbol", "time").alias("bars"))

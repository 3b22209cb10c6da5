"""The screen of all 322 candidates of both libraries, each in its sessions and with its own exits, and what of it holds in both halves and from fold to fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators import barriers, library, registry, rules
from barwright.operators.blocks import numbered
from barwright.plans.library import _FIRED, _IN, _LIB, _LISTED, _WRAPPED, SPAN
from barwright.plans.market import _ALL, _FEAT, _SIGS, hourly, query
from barwright.plans.research import _BARS, _STATE, WARM_UP
from barwright.staging import staged

#: Bars that a candidate of the first library is held at most, and in all the longest.
HOLD = 96
_FIRST = registry.candidates()
_OLD = ", ".join(f"('{i}', '{r}', {registry.HOURS[s][0]}, {registry.HOURS[s][1]}, {t}e0, {x}e0)" for i, r, s, t, x in _FIRST)
_NEW = ", ".join(f"('{c['id']}', '{c['session'].lower()}', {c['target']}e0, {c['stop']}e0, {c['hold']})" for c in _LISTED)
_WITHIN = "CASE c.session " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in _IN.items()) + " END"
#: From signals (id, symbol, rn, side, target, stop, hold) in every, and bars in bb, to trades, one at a time.
_EXITS = """asked AS (SELECT DISTINCT s.symbol, s.rn, s.side, s.target, s.stop, s.hold, b.o1 + CASE WHEN s.side > 0 THEN b.sp1 ELSE 0 END AS entry, b.atr14 AS a FROM every s JOIN bb b ON b.symbol = s.symbol AND b.rn = s.rn WHERE b.atr14 > 0 AND b.third IS NOT NULL),
met AS (SELECT e.*, b.rn AS j, b.close + CASE WHEN e.side > 0 THEN 0 ELSE b.spread END AS c, CASE WHEN e.side > 0 THEN b.low <= e.entry - e.stop * e.a ELSE b.high + b.spread >= e.entry + e.stop * e.a END AS s, CASE WHEN e.side > 0 THEN b.high >= e.entry + e.target * e.a ELSE b.low + b.spread <= e.entry - e.target * e.a END AS t FROM asked e JOIN bb b ON b.symbol = e.symbol AND b.rn > e.rn AND b.rn <= e.rn + e.hold),
ran AS (SELECT symbol, rn, side, target, stop, hold, any_value(entry) AS entry, any_value(a) AS a, min(j) FILTER (s) AS sj, min(j) FILTER (t) AS tj, min(j) FILTER (s AND t) AS bj, max(j) AS lj, arg_max(c, j) AS lc FROM met GROUP BY ALL),
out AS (SELECT *, CASE WHEN sj <= coalesce(tj, sj) THEN -1 WHEN tj IS NOT NULL THEN 1 ELSE 0 END AS outcome FROM ran),
oth AS (SELECT *, CASE outcome WHEN -1 THEN sj WHEN 1 THEN tj ELSE lj END AS exit_rn, CASE outcome WHEN -1 THEN -1.0 WHEN 1 THEN target / stop ELSE side * (lc - entry) / a / stop END AS r FROM out),
joi AS (SELECT e.id, e.symbol, e.rn, e.side, o.outcome, o.exit_rn, o.r, coalesce(o.bj <= o.exit_rn, false) AS amb FROM every e JOIN oth o ON o.symbol = e.symbol AND o.rn = e.rn AND o.side = e.side AND o.target = e.target AND o.stop = e.stop AND o.hold = e.hold),
nxt AS (SELECT a.*, (SELECT min(b.rn) FROM joi b WHERE b.id = a.id AND b.symbol = a.symbol AND b.rn > a.exit_rn) AS nx, row_number() OVER (PARTITION BY id, symbol ORDER BY rn) AS k FROM joi a),
trd AS (SELECT id, symbol, rn, side, outcome, exit_rn, r, amb, nx FROM nxt WHERE k = 1 UNION ALL SELECT n.id, n.symbol, n.rn, n.side, n.outcome, n.exit_rn, n.r, n.amb, n.nx FROM trd g JOIN nxt n ON n.id = g.id AND n.symbol = g.symbol AND n.rn = g.nx)"""
_SCREENED = f"""{_FEAT}, {_SIGS}, {_STATE.removeprefix(_ALL + ', ')}, {_LIB.removeprefix(_ALL + ', ')}, {_FIRED}, {_WRAPPED}, {_BARS},
old(id, rule, a, b, target, stop) AS (VALUES {_OLD}), new(id, session, target, stop, hold) AS (VALUES {_NEW}),
every AS (SELECT o.id, s.symbol, b.rn, s.signal AS side, o.target, o.stop, {HOLD} AS hold FROM (SELECT symbol, time, rule, signal FROM sigs UNION ALL SELECT symbol, time, rule, signal FROM ss) s JOIN old o ON o.rule = s.rule JOIN bb b ON b.symbol = s.symbol AND b.time = s.time
WHERE s.signal <> 0 AND b.rn > {WARM_UP} AND ((s.time + 19800) % 86400) / 3600.0 >= o.a AND ((s.time + 19800) % 86400) / 3600.0 < o.b
UNION ALL SELECT c.id, s.symbol, b.rn, s.signal, c.target, c.stop, c.hold FROM (SELECT symbol, time, id, signal FROM l1 UNION ALL SELECT symbol, time, id, signal FROM l3) s JOIN new c ON c.id = s.id JOIN bb b ON b.symbol = s.symbol AND b.time = s.time JOIN x1 ON x1.symbol = s.symbol AND x1.time = s.time
WHERE b.rn > {WARM_UP} AND {_WITHIN.replace("hr ", "x1.hr ")}),
{_EXITS}"""
_PF = "CASE WHEN sum(r) FILTER (r < 0) < 0 THEN coalesce(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r < 0) WHEN coalesce(sum(r) FILTER (r > 0), 0) = 0 THEN 0.0 END"


def traded(spark, d) -> tuple[DataFrame, DataFrame]:
    """Bars, and the trades of all candidates: id, symbol, rn, side, exit_rn, outcome, both, r."""
    h = barriers.numbered(hourly(spark, d)).withColumn("spread", 0.01 * (F.col("tick_volume") % 5))
    x = staged(rules.every_feature(h.drop("spread", "rn")), "every")
    b = staged(h.join(x.select("symbol", "time", "atr14"), ["symbol", "time"]), "bars")
    old = registry.candidate_signals(rules.signals(x, rules.RULES + rules.STATE_RULES), _FIRST).withColumn("hold", F.lit(HOLD))
    listed = spark.createDataFrame([(c["id"], c["session"], c["target"], c["stop"], c["hold"]) for c in _LISTED], "id string, session string, target double, stop double, hold int")
    within = F.lit(False)
    for s in library.STOPS:
        within = F.when(F.col("session") == s, F.expr(library.inside(s))).otherwise(within)
    hour = F.pmod(F.col("time") + 19_800, F.lit(86_400)) / 3600.0
    new = library.candidate_signals(library.rule_signals(hourly(spark, d), SPAN), _LISTED).drop("rn").join(F.broadcast(listed), "id").withColumn("ist_hour", hour).where(within)
    cols = ["id", "symbol", "time", F.col("signal").alias("side"), "target", "stop", "hold"]
    s = old.select(*cols).unionByName(new.select(*cols)).join(b.select("symbol", "time", "rn"), ["symbol", "time"]).where(F.col("rn") > WARM_UP)
    return b, staged(barriers.simulated_each(b, staged(s.drop("time"), "signals"), ("id",), HOLD), "trades")


@query("candidate_screen", f"WITH {_SCREENED} SELECT id, symbol, count(*) AS trades, count(*) FILTER (r > 0) AS wins, round(avg(r), 6) AS expectancy_r, round(sum(r), 6) AS total_r, round({_PF}, 6) AS profit_factor, round(avg(exit_rn - rn), 6) AS bars_held, count(*) FILTER (outcome = 0) AS timeouts, count(*) FILTER (amb) AS ambiguous, count(*) FILTER (side > 0) AS longs FROM trd GROUP BY 1, 2", "hours", "candles")
def _(spark, d):
    return barriers.screened(traded(spark, d)[1], "id", "symbol").drop("max_dd_r")


#: Least profit factor, in each half, of a candidate that holds.
HOLDS = 1.15


@query("candidate_halves", f"""WITH {_SCREENED}, spl AS (SELECT symbol, (min(rn) + max(rn)) // 2 AS mid FROM bb GROUP BY 1), hal AS (SELECT id, CASE WHEN rn <= mid THEN 1 ELSE 2 END AS half, r FROM trd JOIN spl USING (symbol)),
agg AS (SELECT id, half, count(*) AS n, {_PF} AS pf FROM hal GROUP BY 1, 2) SELECT id, max(n) FILTER (half = 1) AS first_trades, round(max(pf) FILTER (half = 1), 6) AS first_pf, max(n) FILTER (half = 2) AS second_trades, round(max(pf) FILTER (half = 2), 6) AS second_pf, coalesce(min(pf) FILTER (half = 1) >= {HOLDS} AND min(pf) FILTER (half = 2) >= {HOLDS}, false) AS holds FROM agg GROUP BY 1""", "hours", "candles")  # fmt: skip
def _(spark, d):
    bars, t = traded(spark, d)
    middle = bars.groupBy("symbol").agg(F.floor((F.min("rn") + F.max("rn")) / 2).alias("_mid"))
    half = t.join(middle, "symbol").withColumn("half", F.when(F.col("rn") <= F.col("_mid"), 1).otherwise(2))
    gain, loss = F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("r") < 0, -F.col("r")).otherwise(0.0))
    g = half.groupBy("id", "half").agg(F.count(F.lit(1)).alias("n"), F.when(loss > 0, F.try_divide(gain, loss)).when(gain == 0, 0.0).alias("pf"))
    of = lambda c, k: F.max(F.when(F.col("half") == k, F.col(c)))
    out = g.groupBy("id").agg(of("n", 1).alias("first_trades"), of("pf", 1).alias("first_pf"), of("n", 2).alias("second_trades"), of("pf", 2).alias("second_pf"))
    return out.withColumn("holds", F.coalesce((F.col("first_pf") >= HOLDS) & (F.col("second_pf") >= HOLDS), F.lit(False)))


#: Folds of the walk forward, the share of a fold that is for choosing, and least trades there.
FOLDS, SHARE, TRADES = 6, 0.7, 5


@query("candidate_walk_forward", f"""WITH {_SCREENED}, tim AS (SELECT t.id, t.symbol, t.r, b.time FROM trd t JOIN bb b ON b.symbol = t.symbol AND b.rn = t.rn), spa AS (SELECT min(time) AS a, max(time) + 1 - min(time) AS w FROM bb WHERE rn > {WARM_UP}),
fol AS (SELECT id, r, CAST(floor((time - a) * {FOLDS} / w) AS BIGINT) AS fold, (time - a) * {float(FOLDS)} / w - floor((time - a) * {FOLDS} / w) < {SHARE} AS choosing FROM tim, spa),
cho AS (SELECT fold, id, avg(r) AS e, count(*) AS n, row_number() OVER (PARTITION BY fold ORDER BY round(avg(r), 9) DESC, id) AS k FROM fol WHERE choosing GROUP BY 1, 2 HAVING count(*) >= {TRADES}),
tst AS (SELECT fold, id, avg(r) AS e, count(*) AS n FROM fol WHERE NOT choosing GROUP BY 1, 2)
SELECT c.fold, c.id, c.n AS train_trades, round(c.e, 6) AS train_r, coalesce(t.n, 0) AS test_trades, round(t.e, 6) AS test_r FROM cho c LEFT JOIN tst t ON t.fold = c.fold AND t.id = c.id WHERE c.k <= 3""", "hours", "candles")  # fmt: skip
def _(spark, d):
    bars, t = traded(spark, d)
    x = t.select("id", "symbol", "rn", "r").join(bars.select("symbol", "rn", "time"), ["symbol", "rn"])
    span = bars.where(F.col("rn") > WARM_UP).agg(F.min("time").alias("_a"), (F.max("time") + 1 - F.min("time")).alias("_w"))  # one row
    at = (F.col("time") - F.col("_a")) * FOLDS / F.col("_w")
    x = x.join(F.broadcast(span)).withColumns({"fold": F.floor(at), "choosing": at - F.floor(at) < SHARE})
    per = lambda rows, tag: rows.groupBy("fold", "id").agg(F.avg("r").alias(f"{tag}_r"), F.count(F.lit(1)).alias(f"{tag}_trades"))
    best = per(x.where("choosing"), "train").where(F.col("train_trades") >= TRADES)
    best = best.withColumn("_k", F.row_number().over(Window.partitionBy("fold").orderBy(F.round("train_r", 9).desc(), "id"))).where("_k <= 3").drop("_k")
    out = best.join(per(x.where("NOT choosing"), "test"), ["fold", "id"], "left")
    return out.withColumn("test_trades", F.coalesce("test_trades", F.lit(0)))

"""Resampling and multiple-testing statistics. Random choices come from a portable hash, so any engine repeats them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.numeric import correlation

EULER = 0.5772156649015329


def seeds(trade: np.ndarray) -> np.ndarray:
    """What a trade's number brings to mixed(): 31 bits."""
    return (((trade % 2147483647) * 1103515245 + 12345) % 2147483648).astype(np.uint32)


def mixed(seed: np.ndarray, sim: np.ndarray, out: np.ndarray | None = None, spare: np.ndarray | None = None) -> np.ndarray:
    """32 bits for each pair of a trade's seeds() and a simulation's number, by products and shifts that any engine has; here they wrap at 32 bits."""
    h = np.bitwise_xor(seed, ((np.asarray(sim, np.int64) * 69069 + 362437) % 2147483648).astype(np.uint32), out=out)
    spare = np.empty_like(h) if spare is None else spare
    for a, c, shift in ((1664525, 1013904223, 15), (22695477, 1, 13), (1103515245, 12345, 16)):
        np.multiply(h, np.uint32(a), out=h)
        np.add(h, np.uint32(c), out=h)
        np.bitwise_xor(h, np.right_shift(h, np.uint32(shift), out=spare), out=h)
    return h


class Fall:
    """Largest fall of a balance from its peak (or that fall over the peak) and least balance, of results that come in pieces.

    A row of 64 balances whose bounds can't reach the largest fall so far isn't looked at one by one.
    """

    WIDTH = 64

    def __init__(self, start: float, relative: bool = False):
        self.peak, self.balance, self.least, self.most, self.relative = start, start, math.inf, 0.0, relative

    def fell(self, peak: np.ndarray, balance: np.ndarray) -> np.ndarray:
        return (peak - balance) / peak if self.relative else peak - balance

    def add(self, results: np.ndarray) -> None:
        n = len(results)
        if not n:
            return
        balance = np.empty(-(-n // self.WIDTH) * self.WIDTH)
        np.cumsum(results, out=balance[:n])
        balance[:n] += self.balance
        balance[n:] = balance[n - 1]
        self.balance = float(balance[n - 1])
        if math.isnan(self.balance):
            self.most = self.least = math.nan
            return
        rows = balance.reshape(-1, self.WIDTH)
        high, low = rows.max(axis=1), rows.min(axis=1)
        after = np.maximum(np.maximum.accumulate(high), self.peak)
        before = np.concatenate([[self.peak], after[:-1]])
        a, b = self.fell(before, low), self.fell(after, low)
        # the fall at a row's lowest balance lies between the two
        floor = max(self.most, float(np.minimum(a, b).max()))
        look = np.flatnonzero(np.maximum(a, b) >= floor - 1e-9 * abs(floor))
        peaks = np.maximum(np.maximum.accumulate(rows[look], axis=1), before[look][:, None])
        self.most = max(self.most, float(self.fell(peaks, rows[look]).max(initial=0.0)))
        self.peak, self.least = float(after[-1]), min(self.least, float(low.min()))


PIECE = 32_768


def packed(trades: DataFrame) -> DataFrame:
    """strategy, ids, pl: trade_id and net_pl of up to some thousand trades as arrays in bytes, 16 bytes a trade; a missing result moves no balance."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(None if pd.isna(name) else name, own["trade_id"].to_numpy(np.int64).tobytes(), own["net_pl"].to_numpy(float).tobytes()) for name, own in pdf.groupby("strategy", dropna=False)]
            yield pd.DataFrame(out, columns=["strategy", "ids", "pl"])

    return trades.select("strategy", "trade_id", F.coalesce("net_pl", F.lit(0.0)).alias("net_pl")).mapInPandas(pack, "strategy string, ids binary, pl binary")


def by_block(trades: DataFrame, blocks: int) -> DataFrame:
    """packed() trades for each of so many blocks of simulations, dealt out so that each block of a strategy is together."""
    x = packed(trades).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return x.repartition(4 * x.sparkSession.sparkContext.defaultParallelism, "strategy", "block")


def unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """trade_id and net_pl of packed() rows, in order of trade_id."""
    ids, pl = np.frombuffer(b"".join(pdf["ids"]), np.int64), np.frombuffer(b"".join(pdf["pl"]), float)
    order = np.argsort(ids, kind="stable")
    return ids[order], pl[order]


#: Distribution function of the Poisson distribution with mean 1, up to where 32 bits end.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(13)]


def bootstrap(trades: DataFrame, sims: int, block: int = 16) -> DataFrame:
    """Mean result and profit factor of resampled sets of each strategy's trades, by simulation.

    Each trade draws how often it counts in a simulation from a Poisson distribution with mean 1, inverted at a hash of both:
    one pass over the trades, dealt out evenly, in which a task keeps three sums for each simulation of the strategies it
    meets and ``block`` trades' draws. Only these sums are shuffled. A simulation that draws no trade has no mean.
    """
    bounds = [np.uint32(b) for b in (math.ceil(p * 2**32) for p in POISSON) if b < 2**32]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        sim = np.arange(sims, dtype=np.int64)[None, :]
        h, spare, over, drawn, times = (np.empty((block, sims), t) for t in (np.uint32, np.uint32, bool, np.uint8, float))

        def emitted() -> Iterator[pd.DataFrame]:
            for name, x in held.items():
                yield pd.DataFrame({"strategy": name, "sim": np.arange(sims), "n": x[0], "gain": x[1], "loss": x[2]})
            held.clear()

        for pdf in batches:
            for name, own in pdf.groupby("strategy", dropna=False):
                name = None if pd.isna(name) else name
                seed, pl = seeds(own["trade_id"].to_numpy(np.int64)), own["net_pl"].to_numpy(float)
                weights = np.stack([np.ones(len(pl)), np.maximum(pl, 0.0), np.maximum(-pl, 0.0)])
                total = held.setdefault(name, np.zeros((3, sims)))
                for lo in range(0, len(pl), block):
                    n = min(block, len(pl) - lo)
                    mixed(seed[lo : lo + n, None], sim, h[:n], spare[:n])
                    drawn[:n] = 0
                    for b in bounds:
                        np.greater_equal(h[:n], b, out=over[:n])
                        np.add(drawn[:n], over[:n].view(np.uint8), out=drawn[:n])
                    times[:n] = drawn[:n]
                    total += weights[:, lo : lo + n] @ times[:n]
                if len(held) >= 64:
                    yield from emitted()
        yield from emitted()

    x = trades.select("strategy", "trade_id", "net_pl").where("net_pl IS NOT NULL")
    x = x.repartition(4 * x.sparkSession.sparkContext.defaultParallelism, "trade_id")
    parts = x.mapInPandas(partial, "strategy string, sim long, n double, gain double, loss double")
    sums = parts.groupBy("strategy", "sim").agg(*[F.sum(c).alias(c) for c in ("n", "gain", "loss")])
    return sums.select("strategy", "sim", F.try_divide(F.col("gain") - F.col("loss"), F.col("n")).alias("expectancy"), F.try_divide("gain", "loss").alias("profit_factor"))


def interval(sims: DataFrame) -> DataFrame:
    return sims.groupBy("strategy").agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_p{round(q * 100):02d}") for c in ("expectancy", "profit_factor") for q in (0.05, 0.5, 0.95)])


def shuffled_drawdown(trades: DataFrame, sims: int, start: float, block: int = 250) -> DataFrame:
    """Largest drawdown of each strategy's trades in random orders (by a hash of simulation and trade).

    A task takes ``block`` simulations of a strategy; of its trades it holds two numbers each.
    """

    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, pl = unpacked(pdf)
        seed, places = seeds(ids), np.arange(len(ids), dtype=np.uint64)
        h, spare, keys = np.empty_like(seed), np.empty_like(seed), np.empty(len(ids), np.uint64)
        first = int(pdf["block"].iloc[0]) * block
        out = []
        for sim in range(first, min(first + block, sims)):
            # hash and place in one number: sorted, equal hashes stand in order of trade_id
            keys[:] = mixed(seed, np.int64(sim), h, spare)
            np.left_shift(keys, np.uint64(32), out=keys)
            np.bitwise_or(keys, places, out=keys)
            keys.sort()
            fall = Fall(start)
            for lo in range(0, len(keys), PIECE):
                fall.add(pl[(keys[lo : lo + PIECE] & np.uint64(0xFFFFFFFF)).astype(np.int64)])
            out.append((sim, fall.most, fall.least))
        frame = pd.DataFrame(out, columns=["sim", "drawdown", "lowest"])
        frame.insert(0, "strategy", pdf["strategy"].iloc[0])
        return frame

    per = by_block(trades, (sims - 1) // block + 1).groupBy("strategy", "block").applyInPandas(paths, "strategy string, sim long, drawdown double, lowest double")
    return per.groupBy("strategy").agg(F.percentile("drawdown", F.lit(0.5)).alias("drawdown_p50"), F.percentile("drawdown", F.lit(0.95)).alias("drawdown_p95"), F.avg(F.when(F.col("lowest") <= 0, 1.0).otherwise(0.0)).alias("ruin"))


def moments(trades: DataFrame) -> DataFrame:
    """n, mean, population deviation, skewness and kurtosis (3 for a normal distribution) of each strategy's R; the last two are null for constant results."""
    return trades.groupBy("strategy").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function: a series near 0, a continued fraction in the tails (both to 1e-12)."""
    a = F.least(F.abs(z), F.lit(38.0))
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    term = F.struct(a.alias("t"), a.alias("s"))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), term, lambda s, i: F.struct((s["t"] * a * a / (2 * i + 1)).alias("t"), (s["s"] + s["t"] * a * a / (2 * i + 1)).alias("s")), lambda s: F.lit(0.5) + density * s["s"])
    far = F.lit(1.0) - density / F.aggregate(F.sequence(F.lit(60), F.lit(1)), a, lambda s, i: a + i / s)
    upper = F.when(a < 3, near).otherwise(far)
    return F.when(z < 0, 1 - upper).when(z >= 0, upper)


def expected_best(trials: int, variance: float) -> float:
    """The greatest Sharpe ratio that so many trials without skill are expected to reach."""
    nd = NormalDist()
    return math.sqrt(variance) * ((1 - EULER) * nd.inv_cdf(1 - 1 / trials) + EULER * nd.inv_cdf(1 - 1 / (trials * math.e))) if trials > 1 else 0.0


def deflated_sharpe(m: DataFrame, trials: int, variance: float) -> DataFrame:
    """Sharpe ratio of each row of moments, and its probability of passing the best of so many trials by luck.

    Fewer than three results, constant ones, and a ratio whose variance isn't positive give 0.
    """
    best = expected_best(trials, variance)
    sr = F.try_divide("mean", "sd")
    spread = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    told = (F.col("n") >= 3) & (F.col("sd") > 0) & (spread > 0)
    z = F.when(told, (sr - best) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(spread > 0, spread).otherwise(1.0)))
    return m.select("strategy", F.coalesce(sr, F.lit(0.0)).alias("sharpe"), F.lit(best).alias("expected_best"), F.coalesce(normal_cdf(z), F.lit(0.0)).alias("deflated"))


def log_gamma(z: Column) -> Column:
    """The logarithm of the gamma function for z > 0: Stirling's series twelve further up (to 1e-13)."""
    far = z + 12
    below = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0.0), lambda s, i: s + F.log(z + i))
    series = sum(F.lit(c) / F.pow(far, F.lit(2 * k + 1)) for k, c in enumerate((1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)))
    return (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + series - below


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use() of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def incomplete_beta(a: Column, b: Column, x: Column, terms: int = 800) -> Column:
    """The regularized incomplete beta function by its continued fraction, on the side where that converges fast."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def fraction(s: Column) -> Column:
        """Lentz's way through the fraction; odd and even terms have weights of their own."""
        p, q, y = s["p"], s["q"], s["y"]

        def step(now: Column, k: Column) -> Column:
            m = F.floor(k / 2).cast("double")
            weight = F.when(k % 2 == 0, m * (q - m) * y / ((p + k - 1) * (p + k))).otherwise(-(p + m) * (p + q + m) * y / ((p + k - 1) * (p + k)))
            parts = lambda w: F.struct(safe(1 + w * now["d"]).alias("d"), safe(1 + w / now["c"]).alias("c"))
            return let(let(weight, parts), lambda n: F.struct((1 / n["d"]).alias("d"), n["c"].alias("c"), (now["h"] * n["c"] / n["d"]).alias("h")))

        first = F.struct(F.lit(1.0).alias("d"), F.lit(1 / tiny).alias("c"), F.lit(1.0).alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, step, lambda now: now["h"])

    def whole(s: Column) -> Column:
        p, q, y = s["p"], s["q"], s["y"]
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log(1 - y))
        return let(front / p * fraction(s), lambda part: F.when(s["near"], part).otherwise(1 - part))

    def sided(s: Column) -> Column:
        near = s["x"] < (s["a"] + 1) / (s["a"] + s["b"] + 2)
        pick = lambda u, v: F.when(near, u).otherwise(v)
        inner = let(F.struct(pick(s["a"], s["b"]).alias("p"), pick(s["b"], s["a"]).alias("q"), pick(s["x"], 1 - s["x"]).alias("y"), near.alias("near")), whole)
        return F.when(s["x"] <= 0, 0.0).when(s["x"] >= 1, 1.0).otherwise(inner)

    return let(F.struct(a.alias("a"), b.alias("b"), x.alias("x")), sided)


def student_tail(t: Column, df: Column) -> Column:
    """The chance that a Student variable with df degrees of freedom passes t."""

    def tail(s: Column) -> Column:
        half = incomplete_beta(s["v"] / 2, F.lit(0.5), s["v"] / (s["v"] + s["t"] * s["t"]))
        return let(0.5 * half, lambda h: F.when(s["t"] >= 0, h).otherwise(1 - h))

    return let(F.struct(t.alias("t"), df.cast("double").alias("v")), tail)


def mean_tests(trades: DataFrame, tests: int, least: int = 10) -> DataFrame:
    """strategy, n, t, p, corrected: is the mean R above 0? Student's test with the population deviation; p times the number of tests, at most 1. Fewer than ``least`` results, and constant ones, have none."""
    m = trades.groupBy("strategy").agg(F.count("r").alias("n"), F.avg("r").alias("_m"), F.stddev_pop("r").alias("_s"))
    x = m.withColumn("t", F.when((F.col("n") >= least) & (F.col("_s") > 0), F.try_divide("_m", "_s") * F.sqrt("n")))
    x = x.withColumn("p", F.when(F.col("t").isNotNull(), student_tail(F.col("t"), F.col("n") - 1)))
    return x.select("strategy", "n", "t", "p", bonferroni(F.col("p"), tests).alias("corrected"))


def bonferroni(p: Column, tests: int) -> Column:
    return F.when(p.isNotNull(), F.least(F.lit(1.0), p * tests))


def effective_trials(wide: DataFrame, columns: list[str]) -> float:
    """How many independent strategies a correlation matrix amounts to: the exponential of its eigenvalues' entropy.

    The K x K matrix is one aggregate; only it comes to the driver.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = wide.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    m = np.eye(len(columns))
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = row[f"{a}|{b}"] or 0.0
    p = np.clip(np.linalg.eigvalsh(m), 1e-12, None)
    p = p / p.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def information(bars: DataFrame, feature: str, ahead: int, width: int) -> DataFrame:
    """Correlation of a feature with the return some bars ahead: over all rows (ic), and in windows of width rows that have both, without the one that ends at the last row, its mean over its population deviation (icir).

    Fewer than two windows, or than twice the width of rows, give an icir of 0, fewer than two rows an ic of 0.
    """
    w = Window.partitionBy("symbol").orderBy("time")
    x = bars.withColumn("_fwd", F.try_divide(F.lead("close", ahead).over(w), F.col("close")) - 1).where(F.col("_fwd").isNotNull() & F.col(feature).isNotNull())
    x = x.withColumn("_i", F.row_number().over(w) - 1)
    every = x.groupBy("symbol").agg(F.coalesce(correlation(feature, "_fwd"), F.lit(0.0)).alias("ic"), F.count(F.lit(1)).alias("rows"))
    parts = x.groupBy("symbol", F.floor(F.col("_i") / width).alias("_g")).agg(correlation(feature, "_fwd").alias("_ic"), F.count(F.lit(1)).alias("_n"))
    held = parts.join(every.select("symbol", "rows"), "symbol").where((F.col("_n") == width) & (F.col("_g") * width < F.col("rows") - width))
    ratio = held.groupBy("symbol").agg(F.avg("_ic").alias("mean"), F.stddev_pop("_ic").alias("sd"), F.count("_ic").alias("windows"))
    out = every.join(ratio, "symbol", "left")
    enough = (F.col("windows") >= 2) & (F.col("rows") >= 2 * width) & (F.col("sd") > 0)
    return out.select("symbol", "ic", "rows", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce(F.when(enough, F.try_divide("mean", "sd")), F.lit(0.0)).alias("icir"))

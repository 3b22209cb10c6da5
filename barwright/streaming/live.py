"""Stateful operators on event time: duplicate suppression that expires, risk gates, confirmations, gap boxes, tripwires, closes.

State is kept by key in a few values or short lists, and survives a restart with the query's checkpoint. Rows of a batch are
taken in order of time; batches come in order of time but for what the watermark allows to be late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IST, DAY = 19_800, 86_400


def _value(state) -> tuple | None:
    return tuple(state.get()) if state.exists() else None


class Processor(StatefulProcessor):
    """What the operators share: rows in order, nothing to close."""

    order: tuple[str, ...] = ("t", "seq")
    out: tuple[str, ...] = ()

    def frame(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(list(self.order))

    def result(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=list(self.out))

    def close(self) -> None:
        pass


class FirstSeen(Processor):
    """Passes a key's row unless one passed less than ``seconds`` before.

    A state holds the keys of one bucket that passed within those seconds; the older ones go with each batch, and by a timer
    where no batch comes.
    """

    order, out = ("ts", "seq"), ("key", "t", "seq")

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getListState("seen", "key string, at long")

    def keep(self, seen: dict[str, int], timerValues) -> None:  # noqa: N803
        """Holds what can still stop a row: none comes from before the watermark."""
        mark = timerValues.getCurrentWatermarkInMs()
        held = [(k, at) for k, at in seen.items() if (at + self.seconds) * 1000 > mark]
        if held:
            self.seen.put(held)
            self.handle.registerTimer((max(at for _, at in held) + self.seconds) * 1000)
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, kept = dict(map(tuple, self.seen.get())) if self.seen.exists() else {}, []
        frame = self.frame(rows)
        for k, t, seq in zip(frame["key"].tolist(), frame["t"].tolist(), frame["seq"].tolist(), strict=True):
            last = seen.get(k)
            if last is None or t - last >= self.seconds:
                seen[k] = t
                kept.append((k, t, seq))
        self.keep(seen, timerValues)
        yield self.result(kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # later rows may have passed since the timer was set
        if self.seen.exists():
            self.keep(dict(map(tuple, self.seen.get())), timerValues)
        yield self.result([])


def first_seen(rows: DataFrame, keys: list[str], seconds: int, late: str = "10 minutes", buckets: int = 64) -> DataFrame:
    """rows (ts, t: its epoch seconds, seq and keys) of a stream without those that repeat a key within so many seconds: key, t, seq.

    A call of a processor costs tens of milliseconds, so that keys share ``buckets`` states.
    """
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]).alias("key")
    x = rows.withWatermark("ts", late).select("ts", key, "t", "seq").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return x.groupBy("bucket").transformWithStateInPandas(FirstSeen(seconds), "key string, t long, seq long", "Append", "EventTime")


#: Limits of the risk gate; fixed values.
PEAK_FALL, MONTH_FALL, WEEK_FALL, DAY_FALL, DAY_FALL_EARLY = 0.30, 0.25, 0.15, 0.06, 0.03
EARLY_BALANCE, EARLY_LOSERS, PAUSE_LOSSES, STOP_LOSSES, PAUSE_SECONDS, MARGIN_SHARE = 400.0, 2, 3, 5, 4 * 3600, 0.20


def anchors(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """IST day, the Monday of its week (both in days since the epoch), and year * 12 + month."""
    day = (t + IST) // DAY
    return day, day - (day + 3) % 7, day.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64) + 1970 * 12 + 1


def latest(hit: np.ndarray) -> np.ndarray:
    """The place of the last hit up to each row, -1 before the first."""
    return np.maximum.accumulate(np.where(hit, np.arange(len(hit)), -1))


class RiskGate(Processor):
    """May a position be opened? Answers for each row of an account, closed trades (pl not null) included.

    An account's peak and the balances at the start of the day, week and month roll with event time. A fall of 30 % from the
    peak or 25 % in a month halts for good; 15 % in a week, 6 % in a day (3 % and two losing trades below 400), a day stopped
    by five losses in a row, and the four hours after the third or fourth, block entries while they last.
    """

    out = ("account", "t", "seq", "reason", "day_losers", "streak", "peak", "paused_until")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rolling = handle.getValueState("rolling", "peak double, day long, day_balance double, losers long, week long, week_balance double, month long, month_balance double")
        self.streak = handle.getValueState("streak", "losses long, paused_until long, stopped_day long")
        self.halt = handle.getValueState("halt", "reason string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        peak, day, day_balance, losers, week, week_balance, month, month_balance = _value(self.rolling) or (0.0, None, 0.0, 0, None, 0.0, None, 0.0)
        losses, paused, stopped = _value(self.streak) or (0, 0, -1)
        halted = _value(self.halt) is not None
        frame = self.frame(rows)
        t, seq = (frame[c].to_numpy(np.int64) for c in ("t", "seq"))
        balance, equity, margin, pl = (frame[c].to_numpy(float) for c in ("balance", "equity", "margin", "pl"))
        today, monday, this_month = anchors(t)

        def since(period: np.ndarray, now: int | None, value: float) -> tuple[np.ndarray, np.ndarray]:
            """Where each row's period began, -1 in an earlier batch, and the balance there."""
            at = latest(np.concatenate([[now is None or period[0] != now], period[1:] != period[:-1]]))
            return at, np.where(at >= 0, balance[at], value)

        def fell(start: np.ndarray, limit: np.ndarray | float) -> np.ndarray:
            with np.errstate(divide="ignore", invalid="ignore"):
                return (start > 0) & ((start - equity) / start >= limit)

        began, day_start = since(today, day, day_balance)
        _, week_start = since(monday, week, week_balance)
        _, month_start = since(this_month, month, month_balance)
        peaks = np.fmax(np.fmax.accumulate(balance), peak)
        lost = pl < 0
        total = np.cumsum(lost)
        day_losers = total - np.where(began >= 0, total[began] - lost[began], -losers)
        won = latest(pl >= 0)
        streak = total - np.where(won >= 0, total[won], -losses)
        pause, stop = latest(lost & (streak >= PAUSE_LOSSES) & (streak < STOP_LOSSES)), latest(lost & (streak >= STOP_LOSSES))
        until, stopped_day = np.where(pause >= 0, t[pause] + PAUSE_SECONDS, paused), np.where(stop >= 0, today[stop], stopped)
        early = balance < EARLY_BALANCE
        from_peak, in_month = fell(peaks, PEAK_FALL), fell(month_start, MONTH_FALL)
        kill = from_peak | in_month
        after = halted | (np.cumsum(kill) - kill > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            margins = (equity <= 0) | (margin / equity > MARGIN_SHARE)
        checks = {
            "halted": after, "peak": from_peak, "month": in_month, "week": fell(week_start, WEEK_FALL), "stopped": stopped_day == today, "day": fell(day_start, np.where(early, DAY_FALL_EARLY, DAY_FALL)),
            "losers": early & (day_losers >= EARLY_LOSERS), "paused": until > t, "margin": margins,
        }
        reason = np.select(list(checks.values()), [np.array(k, object) for k in checks], np.array("allowed", object))
        if kill.any() and not halted:
            self.halt.update((reason[int(np.argmax(kill))],))
        self.rolling.update((float(peaks[-1]), int(today[-1]), float(day_start[-1]), int(day_losers[-1]), int(monday[-1]), float(week_start[-1]), int(this_month[-1]), float(month_start[-1])))
        self.streak.update((int(streak[-1]), int(until[-1]), int(stopped_day[-1])))
        yield pd.DataFrame(dict(zip(self.out, (key[0], t, seq, reason, day_losers, streak, peaks, until), strict=True)))


def risk_gate(rows: DataFrame) -> DataFrame:
    """rows: account, t, seq, balance, equity, margin, pl (null: no trade was closed)."""
    return rows.groupBy("account").transformWithStateInPandas(RiskGate(), "account string, t long, seq long, reason string, day_losers long, streak long, peak double, paused_until long", "Append", "None")


class Confirmation(Processor):
    """Signals wait for the next bar: it confirms one by closing further on its side, and drops it otherwise. A signal whose next bar is later than ``seconds`` has expired; a timer says so where no bar comes."""

    order, out = ("time",), ("symbol", "time", "side", "outcome", "at")

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getValueState("waiting", "time long, side long, level double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wait, out = _value(self.waiting), []
        for time, close, side in self.frame(rows)[["time", "close", "side"]].itertuples(index=False):
            if wait:
                expired = time > wait[0] + self.seconds
                outcome = "expired" if expired else "confirmed" if wait[1] * (close - wait[2]) > 0 else "dropped"
                out.append((key[0], wait[0], wait[1], outcome, wait[0] + self.seconds if expired else int(time)))
                wait = None
            if side:
                wait = (int(time), int(side), float(close))
        if wait:
            self.waiting.update(wait)
            self.handle.registerTimer((wait[0] + self.seconds) * 1000)
        else:
            self.waiting.clear()
        yield self.result(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wait, out = _value(self.waiting), []
        if wait and (wait[0] + self.seconds) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], wait[0], wait[1], "expired", wait[0] + self.seconds))
            self.waiting.clear()
        yield self.result(out)


def confirmed(bars: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """bars: ts, symbol, time, close, side (1, -1: a signal; 0: none), in order of time. Gives each signal's outcome and when it was known."""
    return bars.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(Confirmation(seconds), "symbol string, time long, side long, outcome string, at long", "Append", "EventTime")


class GapBoxes(Processor):
    """Open fair-value gaps after each bar: a list of boxes, the last two bars, and the sums behind the threshold."""

    order, out = ("time",), ("symbol", "time", "bulls", "bears", "support", "resistance")

    def __init__(self, threshold: float | None):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.boxes = handle.getListState("boxes", "side long, bottom double, top double")
        self.recent = handle.getListState("recent", "high double, low double, close double")
        self.sums = handle.getValueState("sums", "total double, bars long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        boxes = [tuple(b) for b in self.boxes.get()] if self.boxes.exists() else []
        recent = [tuple(b) for b in self.recent.get()] if self.recent.exists() else []
        total, n = _value(self.sums) or (0.0, 0)
        out = []
        for time, high, low, close in self.frame(rows)[["time", "high", "low", "close"]].itertuples(index=False):
            total, n = total + (high - low) / max(low, 1e-9), n + 1
            limit = total / n if self.threshold is None else self.threshold
            if len(recent) == 2:
                (h2, l2, _), (_, _, c1) = recent
                if low > h2 and c1 > h2 and (low - h2) / h2 > limit:
                    boxes.append((1, h2, low))
                elif high < l2 and c1 < l2 and (l2 - high) / high > limit:
                    boxes.append((-1, high, l2))
            boxes = [b for b in boxes if (close >= b[1] if b[0] > 0 else close <= b[2])]
            recent = [*recent[-1:], (high, low, close)]
            tops, bottoms = [b[2] for b in boxes if b[0] > 0], [b[1] for b in boxes if b[0] < 0]
            out.append((key[0], int(time), len(tops), len(bottoms), max(tops, default=None), min(bottoms, default=None)))
        self.boxes.put(boxes) if boxes else self.boxes.clear()
        self.recent.put(recent)
        self.sums.update((float(total), int(n)))
        yield self.result(out)


def gap_boxes(bars: DataFrame, threshold: float | None = None) -> DataFrame:
    """bars: symbol, time, high, low, close of a stream. The same as the batch tracker's open boxes."""
    return bars.groupBy("symbol").transformWithStateInPandas(GapBoxes(threshold), "symbol string, time long, bulls long, bears long, support double, resistance double", "Append", "None")


class Tripwire(Processor):
    """The profit factor of the last ``n`` closed trades after each one: 'stop' below 0.8, 'warn' below 1, else 'fine'; 'early' before there are n."""

    out = ("account", "t", "seq", "factor", "level")

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "pl double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, out = [b[0] for b in self.last.get()] if self.last.exists() else [], []
        for t, seq, pl in self.frame(rows)[["t", "seq", "pl"]].itertuples(index=False):
            last = [*last, float(pl)][-self.n :]
            lost = -sum(x for x in last if x < 0)
            factor = sum(x for x in last if x > 0) / lost if lost > 0 else None
            # the order of adding doesn't decide at a limit
            told = None if factor is None else round(factor, 9)
            level = "early" if len(last) < self.n else "fine" if told is None or told >= 1 else "stop" if told < 0.8 else "warn"
            out.append((key[0], int(t), int(seq), factor if len(last) == self.n else None, level))
        self.last.put([(x,) for x in last])
        yield self.result(out)


def tripwire(closes: DataFrame, n: int = 30) -> DataFrame:
    """closes: account, t, seq, pl of a stream of closed trades."""
    return closes.groupBy("account").transformWithStateInPandas(Tripwire(n), "account string, t long, seq long, factor double, level string", "Append", "None")


class Closes(Processor):
    """Each order of a ticket with each close in time; one without comes with null once the watermark says that none can follow.

    State: orders whose time isn't over, with whether they have met a close, and closes not before the watermark.
    """

    order, out = ("m",), ("order_id", "close_id")

    def __init__(self, within: int, most: int = 100_000):
        self.within, self.most = within, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders, self.closes = handle.getListState("orders", "m long, id long, met boolean"), handle.getListState("closes", "m long, id long")

    def held(self, state, names: list[str]) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in state.get()] if state.exists() else [], columns=names)

    def over(self, orders: pd.DataFrame, mark: int) -> np.ndarray:
        return (orders["m"].to_numpy(np.int64) + self.within) // 1000 < mark

    def keep(self, orders: pd.DataFrame, closes: pd.DataFrame | None, mark: int) -> None:
        if closes is not None:
            closes = closes[closes["m"].to_numpy(np.int64) >= mark * 1000]
            self.closes.put(list(zip(closes["m"].tolist(), closes["id"].tolist(), strict=True))) if len(closes) else self.closes.clear()
        if len(orders):
            self.orders.put(list(zip(orders["m"].tolist(), orders["id"].tolist(), map(bool, orders["met"].tolist()), strict=True)))
            self.handle.registerTimer((int(orders["m"].min()) + self.within) // 1000)
        else:
            self.orders.clear()

    def met(self, orders: pd.DataFrame, closes: pd.DataFrame, seen: np.ndarray) -> Iterator[pd.DataFrame]:
        """Pairs of orders, in order of time, and closes; at most about ``most`` at once. seen marks the orders met."""
        m, at = orders["m"].to_numpy(np.int64), closes["m"].to_numpy(np.int64)
        lo, hi = np.searchsorted(m, at - self.within, "left"), np.searchsorted(m, at, "right")
        ids, close_ids, n = orders["id"].to_numpy(np.int64), closes["id"].to_numpy(np.int64), hi - lo
        part = np.cumsum(n) // self.most
        for own in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
            ends = np.cumsum(n[own])
            if len(own) and ends[-1]:
                which = np.repeat(lo[own] - (ends - n[own]), n[own]) + np.arange(ends[-1])
                seen[which] = True
                yield pd.DataFrame({"order_id": ids[which], "close_id": np.repeat(close_ids[own], n[own])})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = self.frame(rows)
        orders, closes = self.held(self.orders, ["m", "id", "met"]), self.held(self.closes, ["m", "id"])
        new, came = frame.loc[frame["is_order"], ["m", "id"]].assign(met=False), frame.loc[~frame["is_order"], ["m", "id"]]
        if key[0] is None or pd.isna(key[0]):
            came = came[:0]
        fresh, whole = np.zeros(len(new), bool), None
        yield from self.met(new, closes, fresh)
        new = new.assign(met=fresh)
        whole = (pd.concat([orders, new]) if len(orders) else new).sort_values("m", kind="stable")
        seen = whole["met"].to_numpy(bool).copy()
        yield from self.met(whole, came, seen)
        self.keep(whole.assign(met=seen), pd.concat([closes, came]) if len(closes) else came, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, orders = timerValues.getCurrentWatermarkInMs(), self.held(self.orders, ["m", "id", "met"])
        done = self.over(orders, mark)
        alone = orders[done & ~orders["met"].to_numpy(bool)]
        self.keep(orders[~done], None, mark)
        yield pd.DataFrame({"order_id": alone["id"].to_numpy(np.int64), "close_id": pd.array([None] * len(alone), "Int64")})


def closes_of(orders: DataFrame, closes: DataFrame, within: int = 7200, late: str = "10 minutes") -> DataFrame:
    """Each order with each close of its ticket within so many seconds; an order without one comes with null once the watermark, the less of both, says that none can follow. orders: ticket, ts, order_id; closes: ticket, ts, close_id.

    A join of the streams would try each pair of a ticket in state; here both are sorted by time.
    """
    of = lambda x, name: x.where("ts IS NOT NULL").withWatermark("ts", late).select("ts", "ticket", F.unix_micros("ts").alias("m"), F.col(name).alias("id"), F.lit(name == "order_id").alias("is_order"))
    both = of(orders, "order_id").unionByName(of(closes, "close_id"))
    return both.groupBy("ticket").transformWithStateInPandas(Closes(within * 1_000_000), "order_id long, close_id long", "Append", "EventTime")

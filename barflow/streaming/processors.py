"""Stateful processors: order-flow direction, bar validation, regime hysteresis, tick history, heartbeat, repeats, sessions, latency."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barflow import constants as k
from barflow.plans.quality import BarChecker
from barflow.plans.regimes import Hysteresis


def _naive(ts):
    return None if ts is None else pd.Timestamp(ts).tz_localize(None) if pd.Timestamp(ts).tzinfo else pd.Timestamp(ts)


def _rows(frames: Iterator[pd.DataFrame], order) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order. Their number is bounded by what a trigger takes in (``streams.run_in_slices``, or a file source's
    ``maxFilesPerTrigger`` and ``maxBytesPerTrigger``); what came before is in the state."""
    parts = list(frames)
    return pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame()


class TickDirection(StatefulProcessor):
    """Sign of each tick against the previous one of the symbol, which is all the state there is."""

    SCHEMA = "symbol STRING, ts TIMESTAMP, seq BIGINT, price DOUBLE, direction INT"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["ts", "seq"])
        before = self.last.get()[0] if self.last.exists() else None
        prices = pdf["price"].tolist()
        prev = [before, *prices[:-1]]
        pdf["direction"] = [0 if q is None else (p > q) - (p < q) for p, q in zip(prices, prev)]
        self.last.update((float(prices[-1]),))
        yield pdf[["symbol", "ts", "seq", "price", "direction"]]

    def close(self) -> None:
        pass


class BarValidator(StatefulProcessor):
    """Errors of each bar against the last good one; ``halt`` after three bad bars in a row.  Starts anew each session."""

    SCHEMA = ("symbol STRING, dt TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, bar_valid BOOLEAN, "
              "errors ARRAY<STRING>, bad_in_row INT, halt BOOLEAN")

    def __init__(self, **limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "day STRING, close DOUBLE, ts TIMESTAMP, bad INT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["dt"])
        day, close, ts, bad = self.memory.get() if self.memory.exists() else ("", 0.0, None, 0)
        state = BarChecker(close, _naive(ts), bad, **self.limits)
        out = []
        for r in pdf.itertuples(index=False):
            now = _naive(r.dt)
            if str(now.date()) != day:
                day, state = str(now.date()), BarChecker(**self.limits)
            out.append(state.check(r.open, r.high, r.low, r.close, now))
        for i, name in enumerate(("bar_valid", "errors", "bad_in_row", "halt")):
            pdf[name] = [o[i] for o in out]
        kept = None if state.ts is None else pd.Timestamp(state.ts).to_pydatetime()
        self.memory.update((day, float(state.close), kept, int(state.bad)))
        yield pdf[["symbol", "dt", "open", "high", "low", "close", "volume", "bar_valid", "errors", "bad_in_row", "halt"]]

    def close(self) -> None:
        pass


class RegimeConfirmer(StatefulProcessor):
    """Hysteresis per bar; counters restart with the session, the confirmed regime stays."""

    SCHEMA = "symbol STRING, dt TIMESTAMP, regime INT, confirmed_regime INT, bars_since_flip BIGINT"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "day STRING, current INT, held INT, pending INT, count INT, since BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["dt"])
        day, current, held, pending, count, since = (self.state.get() if self.state.exists()
                                                     else ("", k.RANGING, k.MIN_DURATION[k.RANGING], -9, 0, 0))
        h = Hysteresis(current, held)
        h.pending, h.count = (None if pending == -9 else pending), count
        reg, age = [], []
        for dt, r in zip(pdf["dt"], pdf["regime"]):
            today = str(_naive(dt).date())
            if day and today != day:
                h = Hysteresis(h.current, 0)
            day = today
            since = 0 if h.step(int(r)) else since + 1
            reg.append(h.current)
            age.append(since)
        pdf["confirmed_regime"], pdf["bars_since_flip"] = reg, age
        self.state.update((day, int(h.current), int(h.held), -9 if h.pending is None else int(h.pending), int(h.count), int(since)))
        yield pdf[["symbol", "dt", "regime", "confirmed_regime", "bars_since_flip"]]

    def close(self) -> None:
        pass


class RecentTicks(StatefulProcessor):
    """Statistics of the last n ticks and the median of the last lags, over a bounded list in state."""

    SCHEMA = "symbol STRING, ts TIMESTAMP, seq BIGINT, n BIGINT, latest DOUBLE, high DOUBLE, low DOUBLE, range DOUBLE"

    def __init__(self, n: int = 100):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prices = handle.getListState("prices", "price DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["ts", "seq"])
        old = [r[0] for r in self.prices.get()] if self.prices.exists() else []
        every = pd.Series(old + pdf["price"].tolist())
        roll = every.rolling(self.n, min_periods=1)
        m = len(pdf)
        pdf["n"], pdf["latest"] = roll.count().tolist()[-m:], every.tolist()[-m:]
        pdf["high"], pdf["low"] = roll.max().tolist()[-m:], roll.min().tolist()[-m:]
        pdf["n"] = pdf["n"].astype("int64")
        pdf["range"] = pdf["high"] - pdf["low"]
        self.prices.put([(float(x),) for x in every.tolist()[-(self.n - 1):]])
        yield pdf[["symbol", "ts", "seq", "n", "latest", "high", "low", "range"]]

    def close(self) -> None:
        pass


def _set_timer(handle: StatefulProcessorHandle, at_us: int) -> None:
    """The one event-time timer of a key: it fires once the watermark has passed ``at_us``."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(at_us // 1000 + 1)


class Heartbeat(StatefulProcessor):
    """Silences of a symbol beyond the limit of the tick before them. Rows in: ``us`` (time in microseconds), ``limit_us``.

    A silence that ends gives its length. One that has not ended when the watermark passes the limit gives a row without length, by an event-time
    timer; the same silence gives its length later, if it ends.
    """

    SCHEMA = "symbol STRING, us BIGINT, silent_us BIGINT"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us BIGINT, limit_us BIGINT")

    def _out(self, key, since, length) -> pd.DataFrame:
        return pd.DataFrame({"symbol": pd.Series([key[0]] * len(since), dtype=str), "us": pd.Series(since, dtype="int64"),
                             "silent_us": pd.Series(length, dtype="Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["us", "seq"])
        before = [self.last.get()] if self.last.exists() else []
        us, limit = (np.concatenate([np.array([r[i] for r in before], dtype="int64"), pdf[c].to_numpy("int64")]) for i, c in enumerate(("us", "limit_us")))
        gap = np.diff(us)
        ended = gap > limit[:-1]
        last = int(us[-1]), int(limit[-1])
        self.last.update(last)
        _set_timer(self.handle, sum(last))
        yield self._out(key, us[:-1][ended], gap[ended])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._out(key, [self.last.get()[0]], [None])

    def close(self) -> None:
        pass


class RepeatGuard(StatefulProcessor):
    """Whether a signal is kept: the last kept one of its hash is at least ``seconds`` older.

    That time is all the state there is, and it goes when the watermark has passed it by ``seconds``: from then on it decides nothing.
    """

    SCHEMA = "seq BIGINT, hash STRING, us BIGINT, kept BOOLEAN"

    def __init__(self, seconds: float = k.DEDUP_SECONDS):
        self.wait = int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["us", "seq"])
        last, kept = self.last.get()[0] if self.last.exists() else None, []
        for t in pdf["us"].tolist():
            ok = last is None or t - last >= self.wait
            kept.append(ok)
            last = t if ok else last
        pdf["kept"] = kept
        self.last.update((int(last),))
        _set_timer(self.handle, last + self.wait)
        yield pdf[["seq", "hash", "us", "kept"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class SessionState(StatefulProcessor):
    """Running values of one session (symbol and date): number of the bar, day open, high and low so far, bars since the high.

    A new session is a new key, so nothing is carried over; the state of a past one goes ``ttl_seconds`` after its last bar came in.
    """

    SCHEMA = "symbol STRING, trade_date DATE, dt TIMESTAMP, bar_no BIGINT, day_open DOUBLE, high_so_far DOUBLE, low_so_far DOUBLE, since_high BIGINT"

    def __init__(self, ttl_seconds: float = 86400):
        self.ttl = int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "n BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, since BIGINT", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["dt"])
        n, first, high, low, since = self.session.get() if self.session.exists() else (0, float(pdf["open"].iloc[0]), float("-inf"), float("inf"), 0)
        out = []
        for h, l in zip(pdf["high"].tolist(), pdf["low"].tolist()):
            n, since = n + 1, 0 if h > high else since + 1
            high, low = max(high, h), min(low, l)
            out.append((n, first, high, low, since))
        self.session.update((n, first, high, low, since))
        for i, name in enumerate(("bar_no", "day_open", "high_so_far", "low_so_far", "since_high")):
            pdf[name] = [o[i] for o in out]
        yield pdf[["symbol", "trade_date", "dt", "bar_no", "day_open", "high_so_far", "low_so_far", "since_high"]]

    def close(self) -> None:
        pass


class LatencyMonitor(StatefulProcessor):
    """Median of the last lags and what it means; the state is the lags before the next one."""

    SCHEMA = "symbol STRING, seq BIGINT, lag_ms DOUBLE, median_lag_ms DOUBLE, level STRING, acceptable BOOLEAN"

    def __init__(self, n: int = k.LATENCY_WINDOW, warn: float = k.LATENCY_WARN_MS, halt: float = k.LATENCY_HALT_MS):
        self.n, self.warn, self.halt = n, warn, halt

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lags = handle.getListState("lags", "lag_ms DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["ts", "seq"])
        old = [r[0] for r in self.lags.get()] if self.lags.exists() else []
        every = pd.Series(old + pdf["lag_ms"].tolist())
        pdf["median_lag_ms"] = every.rolling(self.n, min_periods=1).median().tolist()[len(old):]
        pdf["level"] = ["CRITICAL" if x > self.halt else "HIGH" if x > self.warn else "OK" for x in pdf["lag_ms"]]
        pdf["acceptable"] = pdf["median_lag_ms"] < self.halt
        self.lags.put([(float(x),) for x in every.tolist()[-(self.n - 1):]])
        yield pdf[["symbol", "seq", "lag_ms", "median_lag_ms", "level", "acceptable"]]

    def close(self) -> None:
        pass


class LastFinished(StatefulProcessor):
    """Value of the latest finished higher-timeframe bar at each bar, NULL before the first; the state is that value."""

    SCHEMA = "symbol STRING, dt TIMESTAMP, value DOUBLE"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["dt", "is_bar"])  # a bar that finishes at the same time comes first
        value, times, values = self.value.get()[0] if self.value.exists() else None, [], []
        for t, is_bar, v in zip(pdf["dt"], pdf["is_bar"], pdf["value"]):
            if is_bar:
                times.append(t)
                values.append(value)
            else:
                value = float(v)
        if value is not None:
            self.value.update((value,))
        yield pd.DataFrame({"symbol": pd.Series([key[0]] * len(times), dtype=str), "dt": pd.Series(times, dtype=pdf["dt"].dtype),
                            "value": pd.Series(values, dtype="float64")})

    def close(self) -> None:
        pass


def keyed(df: DataFrame, processor: StatefulProcessor, mode: str = "None", *keys: str) -> DataFrame:
    """Run a processor per key.  Needs the RocksDB state store provider, see ``streams.configure``.  Event-time timers need a watermark."""
    return df.groupBy(*(keys or ("symbol",))).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode="append", timeMode=mode)



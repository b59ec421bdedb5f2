"""Invariants: chunk borders do not matter, the future does not matter, totals agree, state machines match a plain loop."""
import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.catalog import fixtures as fx
from barflow.operators import kernels
from barflow.operators.asof import asof_join
from barflow.operators.scans import drawdown, forward_fill, running
from barflow.plans import bars as bp
from barflow.plans import features as ft
from barflow.plans import labels as lb
from barflow.plans import ledger as lg
from barflow.plans import regimes as rg
from barflow.plans import sessions as ss

C = F.col
BASE = ("symbol", "dt")


@pytest.fixture(scope="module")
def bars(spark, data):
    return fx.bars(spark, data).cache()


def frame(df, columns):
    return df.select(*BASE, *columns).toPandas().sort_values(list(BASE)).reset_index(drop=True)


def same(a, b, tol=1e-9):
    assert len(a) == len(b) and list(a.columns) == list(b.columns)
    for c in a.columns:
        for x, y in zip(a[c], b[c]):
            if isinstance(x, float) or isinstance(y, float):
                nx, ny = pd.isna(x), pd.isna(y)
                assert nx == ny and (nx or math.isclose(x, y, rel_tol=tol, abs_tol=tol)), (c, x, y)
            else:
                assert x == y, (c, x, y)


PACKS = ("returns", "atr", "bollinger", "rsi", "macd", "stochastic", "cci", "dmi", "vwap", "ticks", "structure", "gaps", "trend", "ema")


@pytest.mark.parametrize("pack", PACKS)
def test_chunk_invariance(bars, pack):
    whole = ft.add_features(bars, pack, bars_per_day=24)
    new = [c for c in whole.columns if c not in bars.columns]
    # Small halo-sized chunks: many borders on little data.
    parts = ft.add_features(bars, pack, bars_per_day=24, rows_per_chunk=1)
    same(frame(whole, new), frame(parts, new), 1e-7)


def test_chunk_invariance_kernels(bars):
    for fn, cols in ((lambda **o: kernels.add_supertrend(bars, **o), ["st_upper", "st_lower", "supertrend"]),
                     (lambda **o: kernels.add_fracdiff(bars, {"fd": "close"}, **o), ["fd"]),
                     (lambda **o: kernels.add_rolling_rank(bars, "close", "rk", 40, 5, **o), ["rk"]),
                     (lambda **o: lb.fixed_barrier(bars, 6, 0.05, 0.03, **o), ["label", "bars_to_exit", "max_excursion"]),
                     (lambda **o: rg.swing_regime(bars, **o), ["trend_direction", "trend_regime"])):
        same(frame(fn(), cols), frame(fn(rows_per_chunk=20), cols))


def test_large_window_rank_equals_small(bars, monkeypatch):
    a = kernels.add_rolling_rank(bars, "close", "rk", 40, 5)
    monkeypatch.setattr(kernels, "SMALL_WINDOW", 10)
    same(frame(a, ["rk"]), frame(kernels.add_rolling_rank(bars, "close", "rk", 40, 5), ["rk"]))


def test_features_ignore_the_future(bars):
    cut = dt.datetime(2024, 1, 20)
    packs = ("returns", "atr", "rsi", "dmi", "vwap", "opening_range", "structure", "trend", "macd")
    full = ft.add_features(bars, *packs, bars_per_day=24)
    new = [c for c in full.columns if c not in bars.columns]
    same(frame(full.where(C("dt") < cut), new), frame(ft.add_features(bars.where(C("dt") < cut), *packs, bars_per_day=24), new), 1e-7)


def test_symbols_do_not_mix(bars):
    one = bars.where("symbol = 'view'")
    full = ft.add_features(bars, "rsi", "ema").where("symbol = 'view'")
    same(frame(full, ["rsi_14", "ema9_dist"]), frame(ft.add_features(one, "rsi", "ema"), ["rsi_14", "ema9_dist"]))


def test_label_uses_only_its_horizon(bars):
    a = lb.fixed_barrier(bars, 6, 0.05, 0.03).where("dt < '2024-01-10'")
    changed = bars.withColumn("close", F.when(C("dt") >= "2024-01-25", C("close") * 3).otherwise(C("close")))
    same(frame(a, ["label"]), frame(lb.fixed_barrier(changed, 6, 0.05, 0.03).where("dt < '2024-01-10'"), ["label"]))


def test_scans_match_a_loop(spark):
    rng = random.Random(3)
    rows, t = [], dt.datetime(2024, 1, 1)
    for i in range(300):
        t += dt.timedelta(minutes=rng.choice([1, 5, 700]))
        rows.append(("a" if i % 3 else "b", t, float(rng.randint(-5, 5)), None if rng.random() < 0.4 else float(i)))
    df = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, x double, v double")
    got = drawdown(running(df, {"s": C("x")}, {"m": C("x")}, bucket="day"), "x", bucket="day")
    got = forward_fill(got.withColumn("f", C("v")), ["f"], bucket="hour").toPandas().sort_values(["symbol", "dt"])
    for _, g in got.groupby("symbol"):
        assert list(g["s"]) == list(g["x"].cumsum())
        assert list(g["m"]) == list(g["x"].cummax())
        assert list(g["drawdown"]) == list(g["x"].cumsum() - g["x"].cumsum().cummax())
        assert list(g["f"].fillna(-1)) == list(g["v"].ffill().fillna(-1))


def test_asof_directions(spark):
    t0 = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([("a", t0 + dt.timedelta(hours=h)) for h in range(0, 72, 5)], "symbol string, dt timestamp_ntz")
    right = spark.createDataFrame([("a", t0 + dt.timedelta(hours=h), h) for h in range(3, 72, 10)], "symbol string, dt timestamp_ntz, v int")
    for direction, pick in (("backward", lambda h: max([x for x in range(3, 72, 10) if x <= h], default=None)),
                            ("forward", lambda h: min([x for x in range(3, 72, 10) if x >= h], default=None))):
        out = asof_join(left, right, ["v"], direction=direction).orderBy("dt").collect()
        assert [r["v"] for r in out] == [pick(h) for h in range(0, 72, 5)]


def test_hysteresis_matches_a_loop(bars):
    r = F.when(C("close") > C("open") + 5, 0).when(C("close") < C("open") - 5, 2).otherwise(1)
    df = bars.withColumn("regime", r)
    got = rg.hysteresis(df).toPandas().sort_values(["symbol", "dt"])
    for _, g in got.groupby("symbol"):
        h, day, since, want = rg.Hysteresis(1, 4), None, 0, []
        for d, reg in zip(g["trade_date"], g["regime"]):
            if day is not None and d != day:
                h = rg.Hysteresis(h.current, 0)
            day = d
            since = 0 if h.step(int(reg)) else since + 1
            want.append((h.current, since))
        assert list(zip(g["confirmed_regime"], g["bars_since_flip"])) == want


def test_supertrend_on_a_walk(spark):
    rng = random.Random(5)
    rows, p, t = [], 100.0, dt.datetime(2024, 1, 1)
    for i in range(400):
        o, p = p, p + rng.gauss(0, 1)
        rows.append(("a", t + dt.timedelta(minutes=i), o, max(o, p) + rng.random(), min(o, p) - rng.random(), p, 1.0))
    df = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, open double, high double, low double, close double, volume double")
    g = kernels.add_supertrend(df, bucket="minute", rows_per_chunk=25).toPandas().sort_values("dt").reset_index(drop=True)
    pc = g["close"].shift()
    tr = pd.concat([g["high"] - g["low"], (g["high"] - pc).abs(), (g["low"] - pc).abs()], axis=1).max(axis=1)
    atr, mid = tr.rolling(10).mean(), (g["high"] + g["low"]) / 2
    up, lo, side = None, None, 1
    for i in range(len(g)):
        if atr[i] != atr[i]:
            continue
        ub, lb_ = mid[i] + 3 * atr[i], mid[i] - 3 * atr[i]
        first = up is None
        up = ub if first or ub < up or pc[i] > up else up
        lo = lb_ if first or lb_ > lo or pc[i] < lo else lo
        if not first:
            side = 1 if side == -1 and g["close"][i] > up else -1 if side == 1 and g["close"][i] < lo else side
        assert math.isclose(g["st_upper"][i], up, rel_tol=1e-9) and math.isclose(g["st_lower"][i], lo, rel_tol=1e-9)
        assert g["supertrend"][i] == side
    assert set(g["supertrend"]) == {1.0, -1.0}


def test_ledger_totals_agree(spark, data):
    from barflow.catalog.trading import ledger
    led = ledger(spark, data).cache()
    total = led.agg(F.sum("net_p")).first()[0]
    assert lg.daily_pnl(led).agg(F.sum("net_p")).first()[0] == total
    assert lg.pnl_summary(led).first()["net_p"] == total
    assert led.where("hold_mins < 0").count() == 0


def test_last_rows_and_grid(bars):
    last = bp.last_rows(bars, 7, "day").groupBy("symbol").count().collect()
    assert all(r["count"] == 7 for r in last)
    grid = bp.fill_grid(bars, "1 hour", False).toPandas()
    for _, g in grid.groupby("symbol"):
        steps = g.sort_values("dt")["dt"].diff().dropna().unique()
        assert list(steps) == [pd.Timedelta(hours=1)]


def test_pullback_state():
    p = ss.Pullback(strict=True)
    assert p.step("UP", 110.0, 100.0, 2.0, 0.0, 0.0) == (False, "WAIT_PULLBACK")
    assert p.step("UP", 108.0, 100.0, 2.0, 0.0, 0.0) == (False, "WAIT_VWAP")
    assert p.step("UP", 100.2, 100.0, 2.0, 0.0, 0.0) == (False, "WAIT_RESUME")
    assert p.step("UP", 101.0, 100.0, 2.0, 0.2, 0.3) == (True, "ENTRY")
    assert p.side is None


def test_flip_lock_state():
    f = ss.FlipLock()
    locked = [f.step(s)[0] for s in (1, 0, 1, 1, 1, 1, 0, 1)]
    assert locked == [0, 0, 3, 2, 1, 0, 0, 0]


def test_context_models_score_every_row_held_out(spark, monkeypatch):
    from barflow.plans import learn as ln
    rows = spark.range(400).selectExpr("id", "case when id % 8 < 5 then cast(id % 8 as int) end as test_fold", "cast(id % 3 = 0 as int) as y",
                                       "case when id % 8 between 1 and 4 then (id % 7) / 7.0D end as proba", "id % 11 / 11.0D as x")
    seen, fit = [], ln.fit_context_model
    monkeypatch.setattr(ln, "fit_context_model", lambda df, *a: seen.append({r.test_fold for r in df.select("test_fold").distinct().collect()}) or fit(df, *a))
    out = {r.id: r for r in ln.cross_fit_context(rows, ["proba", "x"], "y", "p", 2).collect()}
    assert len(out) == 400 and all((r.p is None) == (r.proba is None) for r in out.values())
    assert sorted(map(sorted, seen)) == sorted(sorted({1, 2, 3, 4} - {f}) for f in (1, 2, 3, 4))


def test_context_features_and_the_neutral_path(spark):
    from barflow.plans import learn as ln
    rows = spark.sql("SELECT 1 AS id, CAST('NaN' AS DOUBLE) AS vol_ratio, CAST(NULL AS DOUBLE) AS adx_14, 2D AS bb_width, 0.6D AS proba, 0 AS test_fold, 1 AS meta")
    full = ln.context_features(rows, [c for c in ln.META_FEATURES if c != "proba"])
    r = full.first()
    assert (r.vol_ratio, r.adx_14, r.bb_width, r.pressure_ratio) == (0.0, 0.0, 2.0, 0.0) and set(ln.META_FEATURES) <= set(full.columns)
    assert ln.cross_fit_context(full, ln.META_FEATURES, "meta", "p", 2, neutral=ln.META_NEUTRAL).first().p == 0.55


def test_small_fits_of_the_training_queries(spark, data, monkeypatch):
    """The queries as they are, but for the number of trees: every row comes back, held out, with a probability where its fold has one."""
    from barflow.catalog import audits
    from barflow.plans import learn as ln
    asked, real = [], ln.base_learners
    monkeypatch.setattr(ln, "base_learners", lambda trees=300, **kw: asked.append(trees) or real(4, **kw))
    monkeypatch.setattr(ln, "context_learner", lambda label, trees=100, weight=None, real=ln.context_learner: asked.append(trees) or real(label, 3, weight))
    for name in ("oof", "importance", "stacked", "training_frame"):
        getattr(audits, name).known.clear()
    rows = audits.training_frame(spark, data).count()
    folds = {(r.symbol, r.dt): r.test_fold for r in audits.training_frame(spark, data).select("symbol", "dt", "test_fold").collect()}
    found = audits.m05(spark, data).collect()
    assert len(found) == rows and all((r.proba is None) == (folds[r.symbol, r.dt] is None) for r in found)
    assert all(0 <= r.proba <= 1 for r in found if r.proba is not None)
    for query in (audits.m06, audits.m07, audits.m09):
        assert query(spark, data).count() == rows
    assert audits.m07(spark, data).where("proba is not null and (stacked is null or meta_conf is null)").count() == 0
    assert audits.m07(spark, data).where("proba is null and meta_conf <> 0.55").count() == 0
    assert audits.m13(spark, data).count() == len(audits.FEATURES)
    assert set(asked) == {300, 100}
    for name in ("oof", "importance", "stacked", "training_frame"):
        getattr(audits, name).known.clear()


@pytest.mark.parametrize("bucket", ["month", "day", "hour"])
def test_range_index_equals_brute_force(spark, bucket):
    import datetime as dt
    import random

    from barflow.plans.replay import range_extremes
    rng, begin = random.Random(4), dt.datetime(2024, 1, 30, 22)
    width = {"month": 40000, "day": 3000, "hour": 300}[bucket]
    bars = sorted({(s, begin + dt.timedelta(minutes=rng.randrange(width))) for s in "abc" for _ in range(200)})
    bars = [(s, t, float(rng.randint(50, 99)), float(rng.randint(1, 49))) for s, t in bars]
    where = [(n, rng.choice("abcd"), *sorted(begin + dt.timedelta(minutes=rng.randrange(-width // 5, width + width // 5)) for _ in range(2))) for n in range(150)]
    where += [(200, "a", bars[3][1], bars[3][1]), (201, "a", bars[9][1], bars[5][1])]  # one instant; end before start
    got = range_extremes(spark.createDataFrame(where, "trade_no long, symbol string, entry_ts timestamp_ntz, exit_ts timestamp_ntz"),
                         spark.createDataFrame(bars, "symbol string, dt timestamp_ntz, high double, low double"), bucket=bucket)
    want = set()
    for n, s, a, z in where:
        inside = [b for b in bars if b[0] == s and a <= b[1] <= z]
        if inside:
            want.add((n, len(inside), max(b[2] for b in inside), min(b[3] for b in inside)))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60


def test_forward_filter_by_chunks_equals_the_plain_recursion(spark):
    import datetime as dt

    import numpy as np
    from barflow.plans.regimes import filter_states
    rng = np.random.default_rng(3)
    states = {"means": [[0.0, 0.0], [2.0, 1.0], [-2.0, 3.0]], "covs": [np.eye(2).tolist(), (2 * np.eye(2)).tolist(), [[1.0, 0.3], [0.3, 2.0]]], "weights": [0.5, 0.3, 0.2],
              "trans": [[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.3, 0.6]], "names": {0: 1, 1: 0, 2: 2}, "columns": ["x", "y"]}
    rows = [(s, dt.datetime(2000, 1, 1) + dt.timedelta(days=40 * i), *map(float, rng.normal(0, 2, 2))) for s in "ab" for i in range(80)]
    rows.append(("a", dt.datetime(2020, 1, 1), None, 1.0))
    z = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, x double, y double")
    later = C("dt") >= dt.datetime(2001, 1, 1)
    few, many = ({(r.symbol, r.dt): (r.regime, r.confidence) for r in filter_states(z, states, later, size).collect()} for size in (None, 7))
    assert len(few) == len(many) == len(rows)
    trans, start = np.array(states["trans"]), np.array(states["weights"])
    for s in "ab":
        p = None
        for _, t, *x in sorted(r for r in rows if r[0] == s and r[2] is not None):
            if t < dt.datetime(2001, 1, 1):
                assert few[s, t] == many[s, t] == (None, None)
                continue
            like = []
            for m, c in zip(states["means"], states["covs"]):
                d = np.array(x) - m
                like.append(np.exp(-0.5 * d @ np.linalg.inv(c) @ d) / np.sqrt(np.linalg.det(c)))
            p = (start if p is None else p @ trans) * like
            p = p / p.sum()
            for got in (few[s, t], many[s, t]):
                assert got[0] == states["names"][int(p.argmax())] and abs(got[1] - p.max()) < 1e-9
    assert few["a", dt.datetime(2020, 1, 1)] == (None, None)


def test_positions_that_span_parts(spark):
    from barflow.plans.labels import excursions
    from barflow.plans.replay import position_state
    rows = [(p, b, float((b * 37 + p * 11) % 23), 10.0, 0.5 + (b * p) % 7 / 10) for p in (1, 2) for b in range(1, 120)]
    marks = spark.createDataFrame(rows, "position long, bar long, ltp double, entry double, atr_ratio double").withColumn("move", C("ltp") - C("entry"))
    names = ["position", "bar", "bars_held", "peak", "_prev_ratio", "mfe"]
    small, whole = ({tuple(r) for r in position_state(marks, n).select(*names).collect()} for n in (7, 4096))
    assert small == whole and len(small) == 238
    one, two = ({tuple(r) for r in excursions(marks, ("position",), ("bar",), n).select("position", "bar", "mfe", "mae").collect()} for n in (5, 1000))
    assert one == two and len(one) == 238


def test_one_account_in_one_month_is_several_parts(spark):
    """Running values of one key do not depend on how time is cut, and no part holds the month."""
    import datetime as dt

    from barflow.operators.scans import drawdown, running, streaks
    rows = [("a", dt.datetime(2024, 3, 1) + dt.timedelta(minutes=37 * i), i, (i * 7919) % 13 - 6) for i in range(1000)]
    df = spark.createDataFrame(rows, "account string, ts timestamp_ntz, n long, v long")
    for scan in (lambda d, b: running(d, {"s": C("v")}, {"m": C("v")}, keys=["account"], order=["ts", "n"], bucket=b),
                 lambda d, b: drawdown(d, C("v"), keys=["account"], order=["ts", "n"], bucket=b),
                 lambda d, b: streaks(d, {"k": C("v") > 0}, keys=["account"], order=["ts", "n"], bucket=b)):
        assert len({frozenset(tuple(r) for r in scan(df, b).select(*sorted(scan(df, b).columns)).collect()) for b in ("month", "day", "hour")}) == 1
    assert df.select(F.date_trunc("day", "ts")).distinct().count() > 20


def test_signal_pipeline_gaps_are_those_of_its_bars(spark):
    """Gap of the first open to the last session's close, and that session's range, against plain loops over the bars."""
    from barflow.catalog import fixtures, signals
    from barflow.plans.daily import attach_daily
    bars = fixtures.bars(spark, "/root/testdata/sf0.001")
    got = attach_daily(bars, signals.session_bars(bars)).select("symbol", "dt", "trade_date", "gap_pct", "day_atr_pct").toPandas()
    plain = bars.select("symbol", "dt", "trade_date", "open", "high", "low", "close").toPandas().sort_values(["symbol", "dt"])
    assert len(got) == len(plain)
    want = {}
    for symbol, rows in plain.groupby("symbol"):
        last, ranges = None, []
        for date, session in rows.groupby("trade_date"):
            gap = 0.0 if last is None else (session.open.iloc[0] - last) / (last + 1e-9) * 100
            atr = sum(ranges[-14:]) / 14 / (last + 1e-9) * 100 if len(ranges) >= 14 else 0.0  # the first session has no gap in its range
            want[symbol, date] = gap, atr
            high, low = session.high.max(), session.low.min()
            ranges.append(high - low if last is None else max(high - low, abs(high - last), abs(low - last)))
            last = session.close.iloc[-1]
    gaps = [abs(r.gap_pct - want[r.symbol, r.trade_date][0]) for r in got.itertuples()]
    assert max(gaps) < 1e-6 and (got.gap_pct != 0).any()
    off = [(r.symbol, r.trade_date, r.day_atr_pct, want[r.symbol, r.trade_date][1]) for r in got.itertuples()
           if abs(r.day_atr_pct - want[r.symbol, r.trade_date][1]) > 1e-6]
    assert not off, off[:3]


def random_ledger(spark, n=160):
    """Trades of two accounts over few instants (many ties), some open, on days with and without exits."""
    r, t0, rows = random.Random(7), dt.datetime(2024, 1, 30, 9), []
    for i in range(n):
        entry = t0 + dt.timedelta(hours=3 * r.randrange(40))
        closed = r.random() < 0.7
        rows.append((r.choice("ab"), i, entry, entry + dt.timedelta(minutes=r.choice([0, 10, 180, 3000])) if closed else None,
                     float(r.randrange(1, 9)), 1, r.choice([-3, -1, 0, 2]) if closed else None, closed))
    return rows, spark.createDataFrame(rows, "account string, trade_no long, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, qty int, net_p long, is_closed boolean")


def plain_state(rows, trigger=2, minutes=15, window=5):
    line = sorted([(e, 1, n, a, 0, p) for a, n, e, x, p, q, net, c in rows] + [(x, 0, n, a, net, -p) for a, n, e, x, p, q, net, c in rows if c])
    seen, streaks = {}, {}
    for ts, kind, n, a, net, value in line:
        s = seen.setdefault(a, {"run": 0, "cool": None, "last": [], "open": 0, "exposure": 0.0, "day": None})
        if s["day"] != ts.date():
            s.update(day=ts.date(), closed=0, wins=0, net=0)
        if kind == 0:
            s["run"] = s["run"] + 1 if net <= 0 else 0
            s["cool"] = ts + dt.timedelta(minutes=minutes) if s["run"] >= trigger else s["cool"]
            s["last"] = (s["last"] + [net > 0])[-window:]
            s.update(closed=s["closed"] + 1, wins=s["wins"] + (net > 0), net=s["net"] + net)
            streaks[n] = s["run"]
        else:
            wr = sum(s["last"]) / window if len(s["last"]) == window else None
            yield n, s["closed"], s["wins"], s["net"], s["run"], s["cool"], wr, s["open"], s["exposure"]
        s["open"] += 1 if kind else -1
        s["exposure"] += value
    yield streaks


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_risk_state_is_that_of_a_plain_loop(spark, bucket):
    from barflow.plans import risk as rk
    rows, ledger = random_ledger(spark)
    *want, _ = plain_state(rows)
    got = rk.state_at_entries(ledger, bucket=bucket).select("trade_no", "trades_closed", "wins", "day_net_p", "consec_losses", "cooldown_until", "recent_wr",
                                                            "open_positions", "exposure")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def cost(monkeypatch, module, run):
    """Scans of the line items and shuffles, in the plans that were written on the way and in the last one."""
    plans, real = [], module.materialize
    with monkeypatch.context() as m:
        m.setattr(module, "materialize", lambda df: (plans.append(df), real(df))[1])
        plans.append(run())
    text = [p._jdf.queryExecution().sparkPlan().toString() for p in plans], [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    return sum(t.count("lineitem.parquet") for t in text[0]), sum(t.count("Exchange hashpartitioning") for t in text[1])


def test_risk_state_reads_line_items_once(spark, data, monkeypatch):
    from barflow.catalog.audits import accounts
    from barflow.plans import risk as rk
    scans, shuffles = cost(monkeypatch, rk, lambda: rk.state_at_entries(accounts(spark, data)))
    assert scans == 1 and shuffles <= 7  # line items, orders, pairs, timeline; the rest is the table of parts


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_loss_streaks_are_those_of_a_plain_loop(spark, bucket):
    from barflow.plans import risk as rk
    rows, ledger = random_ledger(spark)
    *_, want = plain_state(rows)
    got = rk.loss_streaks(ledger, bucket=bucket).select("trade_no", "consec_losses", "ts", "cooldown_until").collect()
    assert {r[0]: r[1] for r in got} == want
    assert all(r[3] == (r[2] + dt.timedelta(minutes=15) if r[1] >= 2 else None) for r in got)


def test_loss_streaks_read_line_items_once(spark, data, monkeypatch):
    from barflow.catalog.audits import accounts
    from barflow.plans import risk as rk
    scans, shuffles = cost(monkeypatch, rk, lambda: rk.loss_streaks(accounts(spark, data)))
    assert scans == 1 and shuffles <= 8


def test_setup_fatigue_reads_line_items_once(spark, data, monkeypatch):
    from barflow.catalog.trading import ledger
    from barflow.plans import risk as rk
    scans, _ = cost(monkeypatch, rk, lambda: rk.setup_fatigue(ledger(spark, data).where("is_closed").withColumn("setup", (F.col("trade_no") % 4).cast("int"))))
    assert scans == 1


def test_extreme_times_pass_over_missing_prices(spark):
    from barflow.catalog.quality import extreme_times
    at = [dt.datetime(2024, 1, 1, h) for h in range(4)]
    rows = [("a", at[0], None, None), ("a", at[1], 5.0, 2.0), ("a", at[2], 5.0, 1.0), ("a", at[3], 4.0, 1.0)]
    got = extreme_times(spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, high double, low double")).collect()
    assert [tuple(r) for r in got] == [("a", at[1], at[2])]


def test_calibration_without_probabilities_and_without_staged_files(spark, data):
    import shutil

    from barflow.catalog.audits import once
    from barflow.operators.stage import materialize
    from barflow.plans import learn as ln
    rows = spark.sql("SELECT 1 AS y, CAST(NULL AS DOUBLE) AS proba")
    assert ln.calibrate(ln.platt(rows), rows).first()["calibrated"] is None
    made = []
    get = once(lambda s, d: (made.append(d), materialize(s.range(3)))[1])
    folder = get(spark, data).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert get(spark, data).count() == 3 and len(made) == 1
    shutil.rmtree(folder)
    assert get(spark, data).count() == 3 and len(made) == 2

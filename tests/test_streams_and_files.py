"""Batch equals stream, files with defects, model persistence."""
import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from barflow.catalog import all_queries
from barflow.sources import readers as rd
from barflow.sources import sinks
from barflow.streaming import streams as st

C = F.col


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_stream_hysteresis_equals_batch(spark, data):
    q = all_queries()
    assert rows(q["r13_stream_hysteresis"](spark, data)) == rows(q["q02_hysteresis"](spark, data).select("symbol", "dt", "confirmed_regime", "bars_since_flip"))


def test_stream_validation_equals_batch(spark, data):
    q = all_queries()
    assert rows(q["r06_stream_validation"](spark, data)) == rows(q["q09_bar_validation"](spark, data))


def test_bars_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "symbol,datetime,open,high,low,close,volume\n"
        "x,2024-01-02 09:15:00+05:30,10,12,9,11,5\n"
        "x,2024-01-02 09:15:00+05:30,10,12,9,10.5,5\n"     # same time: the later row stays
        "x,2024-01-02T03:46:00Z,10,12,9,11,\n"             # another offset, no volume
        "x,2024-01-02 09:17:00,10,8,9,11,5\n"              # high below low
        "x,2024-01-02 09:18:00,ten,12,9,11,5\n"            # not a number
        "x,never,10,12,9,11,5\n")
    got = rd.read_bars(spark, str(tmp_path)).orderBy("dt").collect()
    assert [(r["dt"], r["close"], r["volume"]) for r in got] == [(dt.datetime(2024, 1, 2, 9, 15), 10.5, 5.0), (dt.datetime(2024, 1, 2, 9, 16), 11.0, None)]


def test_event_log(spark, tmp_path):
    (tmp_path / "trades_2024-01-02.jsonl").write_text('{"event":"ENTRY","session_trade_number":1,"entry_price":10.5,"features_snapshot":{"rsi":50.0}}\n\n{"event":"EX\n')
    got = rd.read_trade_events(spark, str(tmp_path)).collect()
    assert [(r["event"], r["session_trade_number"], str(r["file_date"]), r["features_snapshot"]) for r in got] == [("ENTRY", 1, "2024-01-02", {"rsi": 50.0})]


def test_require_rows(spark):
    df = spark.range(10)
    assert [{(r.n_rows, r.too_few) for r in rd.require_rows(df, n).collect()} for n in (10, 11)] == [{(10, False)}, {(10, True)}]


DAY = dt.datetime(2024, 1, 2)


def bar_rows(*rows):
    return [(s, t, t.date(), c) for s, t, c in rows]


def test_upsert_is_safe_to_repeat(spark, tmp_path):
    path = str(tmp_path / "t")
    apply = st.upsert_into(path)
    schema = "symbol string, dt timestamp_ntz, trade_date date, close double"
    later = DAY + dt.timedelta(days=1)
    frames = [spark.createDataFrame(bar_rows(*r), schema) for r in ([("a", DAY, 1.0), ("a", later, 2.0)], [("a", DAY, 9.0)], [("a", DAY, 10.0)])]
    assert st.read_upserted(spark, path) is None
    for number in (0, 1, 0, 1):  # after a restart both are delivered again
        apply(frames[number], number)
        assert sorted(r["close"] for r in st.read_upserted(spark, path).collect()) == ([1.0, 2.0] if number == 0 and not st.exists(spark, f"{path}/commits/version=1") else [2.0, 9.0])
    # A batch that wrote its rows and failed before the commit is not seen, and is written anew.
    frames[2].write.partitionBy("trade_date").parquet(f"{path}/rows/version=2")
    assert sorted(r["close"] for r in st.read_upserted(spark, path).collect()) == [2.0, 9.0]
    apply(frames[2], 2)
    assert sorted(r["close"] for r in st.read_upserted(spark, path).collect()) == [2.0, 10.0]


def test_late_rows_are_judged_across_batches(spark, tmp_path):
    path, minute = str(tmp_path / "t"), dt.timedelta(minutes=1)
    apply = st.split_late(path, 60)
    batches = [[(1, DAY), (2, DAY + 5 * minute), (3, DAY + 3 * minute)], [(4, DAY + 2 * minute), (5, DAY + 4 * minute)], [(6, DAY + 9 * minute)]]
    for number in (0, 1, 1, 2):
        apply(spark.createDataFrame(batches[number], "seq bigint, ts timestamp"), number)
    assert {r.seq: r.late == "true" for r in spark.read.parquet(f"{path}/rows").collect()} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: False}


def stepwise(spark, tmp_path, slices, build, schema, wait=0.0):
    """Rows of each slice's micro-batches, and the number of state rows after it."""
    import time
    st.configure(spark)
    base, seen, state = str(tmp_path), [], []
    for rows_ in slices:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{base}/in"))
        once = {"once": True} if wait else {"availableNow": True}
        query = stream.writeStream.option("checkpointLocation", f"{base}/c").trigger(**once).format("parquet").start(f"{base}/out")
        query.awaitTermination()
        every = [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{base}/out").collect()]
        seen.append([r for r in every if r not in sum(seen, [])])
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(wait)
    return seen, state


def test_heartbeat_timer_fires_before_the_silence_ends(spark, tmp_path):
    second = dt.timedelta(seconds=1)
    slices = [[("a", DAY, 1), ("b", DAY, 2)], [("b", DAY + 400 * second, 3)], [("a", DAY + 500 * second, 4), ("b", DAY + 501 * second, 5)]]
    seen, _ = stepwise(spark, tmp_path, slices, lambda s: st.silent_symbols(s, F.lit(300), "1 second"), "symbol string, ts timestamp, seq bigint")
    assert sorted(seen[0]) == [] and sorted(seen[1], key=str) == [("a", DAY, None), ("b", DAY, 400.0)] and seen[2] == [("a", DAY, 500.0)]


def test_state_of_repeats_and_sessions_goes(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    slices = [[(i, f"h{i}", DAY) for i in range(50)], [(100, "x", DAY + 9 * minute)], [(101, "x", DAY + 10 * minute), (102, "h1", DAY + 10 * minute)]]
    seen, state = stepwise(spark, tmp_path / "r", slices, lambda s: st.marked_repeats(s, 120, "1 second"), "seq bigint, hash string, ts timestamp")
    assert state[0] >= 50 and state[2] < 20 and {r[0]: r[2] for r in seen[2]} == {101: False, 102: True}
    bars = [[(s, DAY + i * minute, DAY.date(), 1.0, 2.0 + i, 0.5) for s in "abcdefghij" for i in range(2)], [("a", DAY + dt.timedelta(days=1), (DAY + dt.timedelta(days=1)).date(), 3.0, 4.0, 2.0)]]
    seen, state = stepwise(spark, tmp_path / "s", bars, lambda s: st.session_values(s, 0.5), "symbol string, dt timestamp, trade_date date, open double, high double, low double", 2.0)
    assert state[0] >= 10 and state[1] < state[0] / 2 and seen[1][0][3:] == (1, 3.0, 4.0, 2.0, 0)


def test_many_slices_equal_few(spark):
    schema = "symbol string, ts timestamp, seq bigint, price double"
    ticks = spark.createDataFrame([("ab"[i % 2], DAY + dt.timedelta(seconds=i // 3), i, float(i * 7 % 5)) for i in range(60)], schema)
    for build in (st.tick_directions, st.recent_ticks):
        assert rows(st.run_in_slices([(ticks, "ts")], build, 8)) == rows(st.run_in_slices([(ticks, "ts")], build))


def test_report_and_log_sinks(spark, data, tmp_path):
    from barflow.catalog.trading import ledger
    from barflow.plans.ledger import report_lines
    led = ledger(spark, data)
    sinks.write_report(report_lines(led), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == led.count()
    sinks.write_trades(led, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == led.where("is_closed").count()


def test_model_round_trip(spark, tmp_path):
    from barflow.plans import learn as ln
    df = spark.range(200).select((C("id") % 7).cast("double").alias("a"), (C("id") % 5).cast("double").alias("b"), (C("id") % 7 > 3).cast("int").alias("y"), F.lit(1.0).alias("weight"))
    model = ln.fit_base(spark, {"all": ln.fitting_frame(df, ["a", "b"])}, ["a", "b"], 2)["all"]
    ln.save_model(model, spark.createDataFrame([(5, 0.6)], "h int, accuracy double"), str(tmp_path / "m"))
    again, meta = ln.load_model(spark, str(tmp_path / "m"))
    assert meta.first()["accuracy"] == 0.6
    assert rows(ln.soft_vote(model, df).select("a", "b", "proba").distinct()) == rows(ln.soft_vote(again, df).select("a", "b", "proba").distinct())


def test_folds_keep_their_distance(spark, data):
    got = all_queries()["m01_folds"](spark, data).toPandas()
    for f in got["test_fold"].dropna().unique():
        test = got.loc[got["test_fold"] == f, "i"]
        train = got.loc[got["train_from"] <= f, "i"]
        assert train.max() + 5 < test.min()


def test_sql_functions(spark):
    from barflow.functions.sqlreg import register_sql
    register_sql(spark)
    r = spark.sql("SELECT bf_lot_size(DATE'2025-04-26') AS lot, bf_theta(90D) AS theta, bf_charges(400D, 400D, 65, false) AS charges, bf_atm_strike(21774D) AS atm").first()
    assert (r["lot"], round(r["theta"], 4), round(r["charges"], 2), r["atm"]) == (65, 0.4330, 101.54, 21750)


def test_trade_events_are_written_compressed_in_bounded_files(spark, data, tmp_path):
    from barflow.catalog import fixtures as fx
    trades = fx.trades(spark, data)
    sinks.write_trade_events(trades, str(tmp_path / "plain"))
    sinks.write_trade_events(trades, str(tmp_path / "gz"), "gzip", 500)
    plain, packed = spark.read.text(str(tmp_path / "plain")), spark.read.text(str(tmp_path / "gz"))
    assert rows(plain) == rows(packed)
    files = list((tmp_path / "gz").glob("*.txt.gz"))
    assert len(files) >= plain.count() / 500 and max(spark.read.text(str(f)).count() for f in files) <= 500


def test_trades_are_written_from_one_pass_and_large_months_split(spark, data, monkeypatch):
    from barflow.catalog import sources
    seen = []
    monkeypatch.setattr(sources.sinks, "write_trades", lambda df, path, by: (seen.append(df), df.where("is_closed").write.partitionBy(by).parquet(path)))
    sources.QUERIES["s10_write_trades"](spark, data)
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "RebalancePartitions" in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_silences_are_the_same_from_the_ticks_at_the_edges(spark):
    import random
    st.configure(spark)
    r, at, ticks = random.Random(3), DAY, []
    for i in range(300):
        at += dt.timedelta(seconds=r.choice([0, 1, 20, 59, 60, 61, 200, 299, 300, 301, 900]))
        ticks.append((r.choice("ab"), at, i))
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp, seq bigint")
    want = {(s, a[1], (b[1] - a[1]).total_seconds()) for s in "ab" for a, b in zip([t for t in ticks if t[0] == s], [t for t in ticks if t[0] == s][1:]) if (b[1] - a[1]).total_seconds() > 300}
    for least in (300,):
        got = st.run_in_slices([(df, "ts")], lambda x: st.silent_symbols(x, F.lit(300), "1 second", least)).where("silent_seconds is not null")
        assert {tuple(x) for x in got.collect()} == want
    # A dense hour sends its two edges only.
    dense = pd.DataFrame({"symbol": "a", "seq": range(3600), "us": [i * 1_000_000 for i in range(3600)], "limit_us": 3_600_000_000})
    assert sum(map(len, st.edge_ticks(3_600_000_000)(iter([dense[:1000], dense[1000:]])))) == 2

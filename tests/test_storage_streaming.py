"""Stored tables and streams: idempotent writes, late data, per-symbol state."""

import datetime as dt
import os

import pandas as pd
from pyspark.sql import functions as F

from tickloom import schema as SC
from tickloom.operators import daily as D
from tickloom.plans.catalogue import QUERIES
from tickloom.sources import sample as S, store
from tickloom.streaming import incremental as INC, ticks as TK
from tickloom.streaming.runtime import drain, work_dir


def test_missing_table_reads_as_empty(spark, tmp_path):
    df = store.read_table(spark, str(tmp_path / "none"), SC.SIGNALS)
    assert df.columns == SC.SIGNALS.fieldNames() and df.count() == 0
    assert store.is_readable(spark, str(tmp_path / "none"))[0] is False


def test_typed_read_fills_and_casts(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("2024-01-01", "1.5"), ("2024-01-02", "x")], "date string, forecast string").write.parquet(path)
    got = store.read_table(spark, path, SC.FORECASTS).orderBy("date").collect()
    assert [r.forecast for r in got] == [1.5, None] and got[0].metric is None and got[0].date == dt.date(2024, 1, 1)


def test_partition_overwrite_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(dt.date(2024, 1, d), "A", "A", float(d), 0.0, 0.0) for d in (1, 2, 3)]
    store.write_table(spark.createDataFrame(rows, SC.PRICES), path, SC.PRICES, ["date", "symbol"], ["price"], ["date"])
    late = spark.createDataFrame([(dt.date(2024, 1, 2), "A", "A", 99.0, 0.0, 0.0), (dt.date(2024, 1, 2), "A", "A", 98.0, 0.0, 0.0)], SC.PRICES)
    store.write_table(late, path, SC.PRICES, ["date", "symbol"], ["price"], ["date"])
    assert {r.date.day: r.price for r in store.read_table(spark, path, SC.PRICES).collect()} == {1: 1.0, 2: 98.0, 3: 3.0}


def test_symbol_json_has_one_record_per_day(spark, sf):
    import json
    bars = S.event_bars(spark, sf)
    got = store.symbol_json(bars, ["date", "close"], 5).collect()
    assert got and QUERIES["symbol_json_export"](spark, sf).count() > 0
    for r in got:
        recs = json.loads(r.json)
        assert len(recs) == r.n_rows and [x["date"] for x in recs] == sorted(x["date"] for x in recs)


TICK = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def ticks(spark, folder, name, rows):
    pdf = pd.DataFrame([(i, pd.Timestamp(t), u, "view", v, "{}") for i, t, u, v in rows],
                       columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    spark.createDataFrame(pdf, TICK).coalesce(1).write.parquet(os.path.join(folder, name))


def test_late_day_rewrites_its_own_partition(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "job")
    schema = "symbol string, date date, close double"
    sink = TK.upsert_sink(os.path.join(base, "table"))
    for k, rows in enumerate([[("A", 1, 1.0), ("A", 2, 2.0)], [("A", 3, 3.0), ("A", 1, 10.0)]]):
        df = spark.createDataFrame([(s, dt.date(2024, 1, d), c) for s, d, c in rows], schema)
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        drain(stream.writeStream.option("checkpointLocation", os.path.join(base, "ck")).foreachBatch(sink).trigger(availableNow=True).start())
    got = {r.date.day: r.close for r in spark.read.parquet(os.path.join(base, "table")).collect()}
    assert got == {1: 10.0, 2: 2.0, 3: 3.0}
    sink(spark.createDataFrame([("A", dt.date(2024, 1, 3), 3.0)], schema), 7)  # a replay changes nothing
    assert {r.date.day: r.close for r in spark.read.parquet(os.path.join(base, "table")).collect()} == got


def test_stream_state_continues_and_flags_late_rows(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "job")
    schema = "symbol string, date date, close double"
    for days in ([1, 2], [3], [2]):
        spark.createDataFrame([("A", dt.date(2024, 1, d), float(d)) for d in days], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = TK.ema_stream(spark.readStream.schema(schema).parquet(folder))
        drain(stream.writeStream.format("parquet").option("checkpointLocation", base + "/ck").option("path", base + "/out")
              .trigger(availableNow=True).start())
    got = spark.read.parquet(base + "/out").collect()
    on_time = {r.date.day: r.ema for r in got if not r.late}
    assert on_time == {1: 1.0, 2: 1.25, 3: 1.25 * 0.75 + 3 * 0.25}
    assert [r.date.day for r in got if r.late] == [2]


def test_vanished_and_changed_days_are_dirty(spark):
    schema = "date date, symbol string, price double"
    day = lambda d: dt.date(2024, 1, d)
    now = spark.createDataFrame([(day(1), "A", 1.0), (day(2), "A", 2.0), (day(4), "A", 4.0)], schema)
    was = spark.createDataFrame([(day(1), "A", 1.0), (day(2), "A", 2.5), (day(3), "A", 3.0)], schema)
    assert sorted(r.date.day for r in INC.dirty_days(now, was).collect()) == [2, 3, 4]


def test_refresh_equals_full_recompute(spark, sf):
    p = S.event_prices(spark, sf)
    was = p.where(F.dayofmonth("date") % 6 != 0)
    a = INC.refresh_hist(p, was, D.daily_breadth(was)).toPandas().sort_values("date").reset_index(drop=True)
    b = D.rolling_intelligence(D.daily_breadth(p)).toPandas().sort_values("date").reset_index(drop=True)
    pd.testing.assert_frame_equal(a[b.columns], b)


def test_work_dir_follows_the_session(spark, tmp_path):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = str(tmp_path)
        spark.sparkContext.setCheckpointDir(base)
    assert base in work_dir(spark, "x")


def test_entry_runs(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_late_and_repeated_ticks_reach_their_bars(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "job")
    files = [[(1, "2024-01-01 10:00", 12345, 5.0), (2, "2024-01-01 11:00", 12345, 7.0)], [(3, "2024-01-10 10:00", 12345, 1.0), (3, "2024-01-10 10:00", 12345, 1.0)],
             [(4, "2024-01-11 10:00", 7, 2.0)], [(5, "2024-01-01 12:00", 12345, 9.0), (6, "2024-01-02 09:00", 7, 4.0), (1, "2024-01-01 10:00", 12345, 5.0)]]
    for k, rows in enumerate(files):
        ticks(spark, folder, f"part{k}", rows)
        got = TK.run_bars(TK.tick_stream(spark, folder + "/*", "*.parquet"), base)
    rows = {(r.symbol, r.date.isoformat()): (r.open, r.high, r.low, r.close, r.volume) for r in got.collect()}
    assert rows == {("U12345", "2024-01-01"): (5.0, 9.0, 5.0, 9.0, 3.0), ("U12345", "2024-01-10"): (1.0, 1.0, 1.0, 1.0, 1.0),
                    ("U0007", "2024-01-11"): (2.0, 2.0, 2.0, 2.0, 1.0), ("U0007", "2024-01-02"): (4.0, 4.0, 4.0, 4.0, 1.0)}
    assert [r.date.isoformat() for r in TK.late_days(spark, base).collect()] == ["2024-01-01"]
    replay = spark.createDataFrame([("U0007", 4, dt.datetime(2024, 1, 11, 10), 2.0, dt.date(2024, 1, 11))],
                                   "symbol string, event_id bigint, ts timestamp_ntz, value double, date date")
    TK.bar_sink(base)(replay, 2)  # the third batch once more
    assert spark.read.parquet(base + "/table").count() == 4


def test_a_stopped_merge_goes_on_from_its_side_table(spark, tmp_path):
    path = str(tmp_path / "table")
    sink = TK.upsert_sink(path)
    schema = "symbol string, date date, close double"
    day = dt.date(2024, 1, 3)
    sink(spark.createDataFrame([("A", day, 1.0), ("B", day, 2.0)], schema), 0)
    sink(spark.createDataFrame([("A", day, 5.0)], schema), 1)
    spark.createDataFrame([("A", day, 5.0)], schema).write.mode("overwrite").partitionBy("date").parquet(path)  # died while replacing
    sink(spark.createDataFrame([("A", day, 5.0)], schema), 1)
    assert {r.symbol: r.close for r in spark.read.parquet(path).collect()} == {"A": 5.0, "B": 2.0}

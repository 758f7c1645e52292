"""Row frames at every block size, and cases that once gave other answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.functions import parse as ps
from marketlens.operators import alerts as al
from marketlens.operators import indicators as ind
from marketlens.operators import serving as sv
from marketlens.operators.frames import with_row_blocks
from marketlens.sources.tables import load_table

TS = dt.datetime(2024, 1, 1)
TRADE = "event_id bigint, symbol string, exchange string, price double, volume double, ts timestamp_ntz"


def _rows(n, step):
    return [(i, "HOT" if i % 3 else "B", "x", 100.0 + (i * 37 % 101) / 7, 1.0, step(i)) for i in range(n)]


@pytest.mark.parametrize("step", [lambda i: TS + dt.timedelta(seconds=i), lambda i: TS + dt.timedelta(days=i // 400),
                                  lambda i: None if i % 2 else TS], ids=["seconds", "days", "missing"])
def test_block_size_changes_no_bit(spark, step):
    t = spark.createDataFrame(_rows(1200, step), TRADE)
    got = [ind.enrich(t, block_rows=b).orderBy("event_id").collect() for b in (64, 1000, 1_000_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 1200


def test_positions_follow_time_and_id(spark):
    t = spark.createDataFrame(_rows(500, lambda i: [TS, None, TS + dt.timedelta(seconds=1)][i % 3])
                              + [(200_000 + i, "B", "x", 1.0, 1.0, TS) for i in range(3)], TRADE)
    rows = with_row_blocks(t, halo=2, block_rows=50).filter(~F.col("_halo")).collect()
    for s in ("HOT", "B"):
        own = sorted((r for r in rows if r.symbol == s), key=lambda r: r._pos)
        assert [r._pos for r in own] == list(range(1, len(own) + 1))
        keys = [(r.ts is not None, r.ts or TS, r.event_id) for r in own]
        assert keys == sorted(keys)


def test_building_a_query_runs_no_job(spark):
    t = spark.createDataFrame(_rows(50, lambda i: TS), TRADE)
    seen = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    ind.enrich(t), al.state_timeline(t), al.first_trigger(_alerts(spark, [("a", [("B", "rsi_below", "30")])]), al.state_timeline(t))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == seen


def _alerts(spark, rows):
    return spark.createDataFrame([(i, i, c, "e", "active", False) for i, c in rows],
                                 "id string, name string, conditions array<struct<symbol:string,type:string,threshold:string>>, "
                                 "email string, status string, triggered boolean")


def test_zero_default_counts_the_first_update(spark):
    a = _alerts(spark, [("low", [("B", "rsi_below", "30")]), ("band", [("B", "bollinger_upper", "")]),
                        ("high", [("B", "rsi_above", "30")]), ("none", [])])
    t = spark.createDataFrame([(7, "B", "x", 0.0, 1.0, TS)], TRADE)
    tl = al.state_timeline(t)
    state = al.latest_state(t)
    snap = {r.id for r in al.evaluate_alerts(a, state, zero_default=True).collect() if r.fired}
    first = {r.id for r in al.first_trigger(a, tl, zero_default=True).collect()}
    assert snap == first == {"low", "band", "none"}
    assert {r.id for r in al.first_trigger(a, tl).collect()} == {"none"}
    # the same without the columns about the state before
    bare = tl.select("symbol", "ts", "event_id", *al.STATE_FIELDS)
    assert {r.id for r in al.first_trigger(a, bare, zero_default=True).collect()} == first


def test_rejected_submissions_take_no_number(spark):
    reg = _alerts(spark, [])
    new = spark.createDataFrame([("a", [("B", "price_above", "1")], "e", 0), ("b", [("B", "price_above", "")], "e", 1),
                                 ("c", [("B", "macd_positive", "")], "e", 20_005), ("", [("B", "price_above", "1")], "e", 3)],
                                "name string, conditions array<struct<symbol:string,type:string,threshold:string>>, email string, seq int")
    assert sorted(r.id for r in al.create_alerts(reg, new).collect()) == ["a_0", "c_1"]


def test_detail_reads_the_buffer_only(spark):
    rows = [(i, "RARE" if i < 20 else "B", "x", 1.0, 1.0, TS + dt.timedelta(seconds=i)) for i in range(150)]
    t = spark.createDataFrame(rows, TRADE)
    assert sv.symbol_trades(t, "RARE", "B").count() == 0
    assert sv.symbol_trades(t, "B", "B").count() == 10 and sv.symbol_trades(t, "B", "A").count() == 50


def test_offsets_are_applied(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00+02:00",), ("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("2024-01-01",), ("x",), (None,)], "s string")
    got = [r[0] for r in df.select(ps.parse_event_time("s", as_ntz=True)).collect()]
    assert got == [dt.datetime(2023, 12, 31, 22), TS, TS, TS, None, None]


def test_appended_files_are_seen(spark, scratch):
    spark.range(10).write.parquet(scratch + "/t.parquet")
    assert load_table(spark, scratch, "t").count() == 10
    spark.range(5).write.mode("append").parquet(scratch + "/t.parquet")
    assert load_table(spark, scratch, "t").count() == 15


def test_messages_are_parsed_once(spark):
    raw = spark.createDataFrame([('{"stream":"a@aggTrade","data":{"s":"B","p":"1","E":"5"}}', "t")], "value string, ingest_time string")
    for df in (ps.valid_envelope(ps.parse_json_envelope(raw)), ps.normalize_binance(raw), ps.normalize_coinbase(raw)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1

"""Streams equal batch: statistics (update mode), arbitrage (append mode),
late rows, restart from checkpoint, keyed-state indicators and alert latch."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from marketlens.operators import alerts as al
from marketlens.operators import indicators as ind
from marketlens.operators.arbitrage import arbitrage
from marketlens.operators.stats import window_stats
from marketlens.plans.common import load_table, load_trades, r6
from marketlens.plans.q_alerts import derive_alerts
from marketlens.plans.q_parse import envelope_messages
from marketlens.functions.parse import parse_envelope
from marketlens.sources.streams import SourceConfig, read_raw_stream
from marketlens.streaming import jobs, stateful
from marketlens.streaming.sinks import SinkConfig, upsert_latest, read_latest


def _write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    # a file source goes by the files' times: later names are later files
    at = 1_700_000_000 + sum(x < name for x in os.listdir(folder))
    os.utime(path, (at, at))


def _envelope_files(spark, folder, n_files=4):
    raw = envelope_messages(load_table(spark, SF001, "events")).orderBy("ts").toPandas()
    chunks = [raw.iloc[i::1] for i in range(1)]
    size = (len(raw) + n_files - 1) // n_files
    for i in range(n_files):
        part = raw.iloc[i * size:(i + 1) * size]
        _write_lines(folder, f"part-{i:03d}.json", part["value"].tolist())
    return raw


def _write_chunks(spark, pdf, folder, n):
    """Write a pandas frame as n Spark Parquet folders (one file each), in order."""
    size = (len(pdf) + n - 1) // n
    for i in range(n):
        spark.createDataFrame(pdf.iloc[i * size:(i + 1) * size]).coalesce(1) \
             .write.parquet(os.path.join(folder, f"c{i}"))


def _collect_batches(store):
    def fn(df, batch_id):
        store.append(df.toPandas())
    return fn


def test_stats_stream_equals_batch_and_drops_late(spark, scratch):
    src = os.path.join(scratch, "in")
    _envelope_files(spark, src)
    # one row far behind the watermark, in a later file
    late = {"stream": "view@aggTrade",
            "data": {"s": "VIEW", "p": "1.0", "E": "1000", "q": "1"}}
    ticks = parse_envelope(read_raw_stream(spark, SourceConfig(format="text", path=src,
                                                               max_files_per_trigger=1)))
    stats = jobs.stats_stream(ticks, "5 minutes", watermark="10 minutes")
    out = []
    q = (stats.writeStream.outputMode("update").foreachBatch(_collect_batches(out))
         .option("checkpointLocation", os.path.join(scratch, "ck")).start())
    q.processAllAvailable()
    _write_lines(src, "part-999.json", [json.dumps(late)])
    q.processAllAvailable()
    dropped = jobs.late_rows(q)
    q.stop()
    assert dropped == 1
    got = pd.concat(out).drop_duplicates(["symbol", "window_start"], keep="last")
    raw = envelope_messages(load_table(spark, SF001, "events"))
    batch = window_stats(parse_envelope(raw).withColumnRenamed("timestamp", "ts")
                         .filter(F.col("ts").isNotNull()), "5 minutes").toPandas()
    assert len(got) == len(batch)
    m = got.merge(batch, on=["symbol", "window_start"], suffixes=("_s", "_b"))
    assert len(m) == len(batch)
    assert (m.trade_count_s == m.trade_count_b).all()
    assert ((m.avg_price_s - m.avg_price_b).abs() < 1e-9).all()


def test_stats_stream_restart_from_checkpoint(spark, scratch):
    src = os.path.join(scratch, "in")
    raw = envelope_messages(load_table(spark, SF001, "events")).orderBy("ts").toPandas()
    half = len(raw) // 2
    _write_lines(src, "a.json", raw["value"].iloc[:half].tolist())
    sink = os.path.join(scratch, "latest")
    cfg = SourceConfig(format="text", path=src)

    def run():
        ticks = parse_envelope(read_raw_stream(spark, cfg))
        q = (jobs.stats_stream(ticks, "1 day", watermark="1 day").writeStream
             .outputMode("update").foreachBatch(upsert_latest(sink))
             .option("checkpointLocation", os.path.join(scratch, "ck"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    run()
    first = read_latest(spark, sink).toPandas()
    _write_lines(src, "b.json", raw["value"].iloc[half:].tolist())
    run()                                   # restarts from the checkpoint
    latest = read_latest(spark, sink).toPandas().set_index("symbol").sort_index()
    batch = window_stats(parse_envelope(envelope_messages(load_table(spark, SF001, "events")))
                         .withColumnRenamed("timestamp", "ts").filter(F.col("ts").isNotNull()),
                         "1 day")
    from marketlens.operators.serving import latest_stats
    exp = latest_stats(batch).toPandas().set_index("symbol").sort_index()
    assert len(first) == 5
    assert list(latest.index) == list(exp.index)
    assert (latest.trade_count.values == exp.trade_count.values).all()


def _unified_json(spark, folder, n_files=3):
    t = load_trades(spark, SF001).orderBy("ts").toPandas()
    t["timestamp"] = t["ts"].dt.strftime("%Y-%m-%dT%H:%M:%S.%f")
    recs = [json.dumps({"exchange": r.exchange, "symbol": r.symbol, "price": r.price,
                        "volume": r.volume, "timestamp": r.timestamp, "trade_id": str(r.event_id)})
            for r in t.itertuples()]
    size = (len(recs) + n_files - 1) // n_files
    for i in range(n_files):
        _write_lines(folder, f"p{i}.json", recs[i * size:(i + 1) * size])
    # sentinel far later: closes every window
    _write_lines(folder, "z.json", [json.dumps({"exchange": "binance", "symbol": "ZZZ",
                                                "price": 1.0, "volume": 1.0,
                                                "timestamp": "2030-01-01T00:00:00",
                                                "trade_id": "x"})])


def test_arbitrage_stream_append_equals_batch(spark, scratch):
    src = os.path.join(scratch, "u")
    _unified_json(spark, src)
    raw = read_raw_stream(spark, SourceConfig(format="text", path=src, max_files_per_trigger=1))
    from marketlens.functions.parse import parse_unified
    u = parse_unified(raw, broker_ts=None)
    arb = jobs.arbitrage_stream(u, "1 day", watermark="1 hour", symbol_mode=None)
    out = []
    q = (arb.writeStream.outputMode("append").foreachBatch(_collect_batches(out))
         .option("checkpointLocation", os.path.join(scratch, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = pd.concat(out) if out else pd.DataFrame()
    batch = arbitrage(load_trades(spark, SF001), "1 day").toPandas()
    assert len(got) == len(batch) > 0
    key = ["symbol", "window_start"]
    m = got.merge(batch, on=key, suffixes=("_s", "_b"))
    assert len(m) == len(batch)
    assert (m.buy_exchange_s == m.buy_exchange_b).all()
    assert ((m.arbitrage_percentage_s - m.arbitrage_percentage_b).abs() < 1e-9).all()


def test_stream_indicators_equal_batch(spark, scratch):
    t = load_trades(spark, SF001)
    pdf = t.select("symbol", F.col("ts").cast("timestamp").alias("timestamp"), "event_id",
                   "price").orderBy("timestamp").toPandas()
    src = os.path.join(scratch, "ticks")
    _write_chunks(spark, pdf, src, 4)
    schema = "symbol string, timestamp timestamp, event_id long, price double"
    ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*/*.parquet")
    out = []
    q = (stateful.stream_indicators(ticks).writeStream.outputMode("append")
         .foreachBatch(_collect_batches(out))
         .option("checkpointLocation", os.path.join(scratch, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = pd.concat(out).set_index("event_id").sort_index()
    exp = ind.enrich(t).toPandas().set_index("event_id").sort_index()
    assert len(got) == len(exp)
    for c in ind.INDICATOR_COLUMNS:
        a, b = got[c].astype(float), exp[c].astype(float)
        assert (a.isna() == b.isna()).all(), c
        assert ((a - b).abs().fillna(0) < 1e-6).all(), c


def test_stream_alert_latch_equals_batch(spark, scratch):
    t = load_trades(spark, SF001)
    tl = al.state_timeline(t)
    alerts = derive_alerts(t)
    exp = al.first_trigger(alerts, tl).toPandas()
    exp = exp.set_index("id").sort_index()
    assert (exp["name"] == "no_conditions").any()
    pdf = tl.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").toPandas()
    src = os.path.join(scratch, "tl")
    _write_chunks(spark, pdf, src, 3)
    stream = spark.readStream.schema(tl.withColumn("ts", F.col("ts").cast("timestamp")).schema) \
                  .option("maxFilesPerTrigger", 1).parquet(src + "/*/*.parquet")
    out = []
    q = (stateful.stream_alert_latch(stream, alerts).writeStream.outputMode("append")
         .foreachBatch(_collect_batches(out))
         .option("checkpointLocation", os.path.join(scratch, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = pd.concat(out).set_index("id").sort_index()
    assert list(got.index) == list(exp.index)
    assert (got.trigger_event_id.values == exp.trigger_event_id.values).all()


def test_alerts_stream_and_observe(spark, scratch):
    from marketlens.operators.rules import evaluate_rules
    from marketlens.streaming.sinks import write_alerts_stream, observe_trades
    t = load_trades(spark, SF001)
    e = ind.enrich_for_rules(t).withColumn("ts", F.col("ts").cast("timestamp"))
    src = os.path.join(scratch, "rows")
    _write_chunks(spark, e.toPandas(), src, 2)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*/*.parquet")
    stream = observe_trades(stream.withColumnRenamed("ts", "timestamp"), "progress") \
        .withColumnRenamed("timestamp", "ts")
    out = os.path.join(scratch, "alerts")
    q = write_alerts_stream(stream, SinkConfig(format="parquet", path=out,
                                               checkpoint=os.path.join(scratch, "ck"),
                                               trigger={"availableNow": True}))
    q.awaitTermination()
    seen = sum(p["observedMetrics"]["progress"]["messages"] for p in q.recentProgress
               if "progress" in p.get("observedMetrics", {}))
    got = spark.read.parquet(out).count()
    assert got == evaluate_rules(ind.enrich_for_rules(t)).count() > 0
    assert seen == t.count()


def test_job_runners_over_file_streams(spark, scratch):
    """run_stats_job / run_arbitrage_job end to end, with file sources and
    memory sinks standing in for Kafka (same code path behind the config)."""
    src = os.path.join(scratch, "env")
    _envelope_files(spark, src, n_files=2)
    q = jobs.run_stats_job(spark, SourceConfig(format="text", path=src),
                           SinkConfig(format="memory", query_name="stats_kv",
                                      checkpoint=os.path.join(scratch, "ck1")),
                           width="1 day", watermark="1 day")
    q.processAllAvailable()
    q.stop()
    kv = spark.sql("SELECT key, value FROM stats_kv").toPandas()
    assert len(kv) > 0 and set(kv["key"]) <= {"VIEW", "CLICK", "PURCHASE", "SIGNUP", "ERROR"}
    assert all('"trade_count"' in v for v in kv["value"])

    usrc = os.path.join(scratch, "uni")
    t = load_trades(spark, SF001).orderBy("ts").toPandas()
    recs = []
    for r in t.itertuples():
        sym = "btcusdt" if r.exchange == "binance" else "btcusd"
        recs.append(json.dumps({"exchange": r.exchange, "symbol": sym, "price": r.price,
                                "volume": r.volume, "trade_id": str(r.event_id),
                                "timestamp": r.ts.strftime("%Y-%m-%dT%H:%M:%S.%f")}))
    _write_lines(usrc, "a.json", recs)
    _write_lines(usrc, "z.json", [json.dumps({"exchange": "kraken", "symbol": "ethusd",
                                              "price": 1.0, "volume": 1.0, "trade_id": "x",
                                              "timestamp": "2030-01-01T00:00:00"})])
    q = jobs.run_arbitrage_job(spark, SourceConfig(format="text", path=usrc, max_files_per_trigger=1),
                               SinkConfig(format="memory", query_name="arb_kv",
                                          checkpoint=os.path.join(scratch, "ck2")),
                               width="1 day", watermark="1 hour")
    q.processAllAvailable()
    q.stop()
    arb = spark.sql("SELECT key, value FROM arb_kv").toPandas()
    assert len(arb) > 0 and set(arb["key"]) == {"btc"}      # usdt and usd venues meet (Q1)
    assert all('"detection_time"' in v for v in arb["value"])


def test_stream_indicators_out_of_order_with_watermark(spark, scratch):
    """Files arrive with rows shuffled inside a 1-hour span; with a watermark
    the processor releases rows in event-time order and equals the batch."""
    t = load_trades(spark, SF001)
    pdf = t.select("symbol", F.col("ts").cast("timestamp").alias("timestamp"), "event_id",
                   "price").orderBy("timestamp").toPandas()
    pdf["hour"] = pdf["timestamp"].dt.floor("h")
    parts = [g.sample(frac=1.0, random_state=1) for _, g in pdf.groupby("hour")]
    shuffled = pd.concat(parts).drop(columns="hour")
    # a final far-future tick per symbol pushes the watermark past everything
    tail = pd.DataFrame({"symbol": sorted(pdf.symbol.unique()),
                         "timestamp": pd.Timestamp("2030-01-01"), "event_id": -1, "price": 1.0})
    src = os.path.join(scratch, "ticks")
    _write_chunks(spark, pd.concat([shuffled, tail], ignore_index=True), src, 6)
    schema = "symbol string, timestamp timestamp, event_id long, price double"
    ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*/*.parquet")
    out = []
    q = (stateful.stream_indicators(ticks, watermark="2 hours").writeStream.outputMode("append")
         .foreachBatch(_collect_batches(out))
         .option("checkpointLocation", os.path.join(scratch, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = pd.concat(out)
    got = got[got.event_id >= 0].set_index("event_id").sort_index()
    exp = ind.enrich(t).toPandas().set_index("event_id").sort_index()
    assert len(got) == len(exp)
    for c in ind.INDICATOR_COLUMNS:
        a, b = got[c].astype(float), exp[c].astype(float)
        assert (a.isna() == b.isna()).all(), c
        assert ((a - b).abs().fillna(0) < 1e-6).all(), c


def test_stream_alert_latch_out_of_order_with_watermark(spark, scratch):
    t = load_trades(spark, SF001)
    tl = al.state_timeline(t)
    alerts = derive_alerts(t)
    exp = al.first_trigger(alerts, tl).toPandas()
    exp = exp.set_index("id").sort_index()
    pdf = tl.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").toPandas()
    pdf["day"] = pdf["ts"].dt.floor("D")
    shuffled = pd.concat([g.sample(frac=1.0, random_state=3) for _, g in pdf.groupby("day")])
    shuffled = shuffled.drop(columns="day")
    tail = shuffled.iloc[:0].copy()
    for sym in sorted(pdf.symbol.unique()):          # far-future rows move the watermark
        row = pdf[pdf.symbol == sym].iloc[-1].drop("day").copy()
        row["ts"], row["event_id"] = pd.Timestamp("2030-01-01"), -1
        tail = pd.concat([tail, row.to_frame().T])
    src = os.path.join(scratch, "tl")
    _write_chunks(spark, pd.concat([shuffled, tail], ignore_index=True).astype(shuffled.dtypes.to_dict()),
                  src, 5)
    schema = tl.withColumn("ts", F.col("ts").cast("timestamp")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*/*.parquet")
    out = []
    q = (stateful.stream_alert_latch(stream, alerts, watermark="1 day").writeStream
         .outputMode("append").foreachBatch(_collect_batches(out))
         .option("checkpointLocation", os.path.join(scratch, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = pd.concat(out).set_index("id").sort_index()
    got = got[got.trigger_event_id >= 0]
    assert list(got.index) == list(exp.index)
    assert (got.trigger_event_id.values == exp.trigger_event_id.values).all()


def test_progress_totals_over_replays_and_restarts(spark, scratch):
    """Totals outlive the kept progress records; a batch that comes twice counts once."""
    import datetime as dt
    from types import SimpleNamespace
    from marketlens.streaming.progress import ProgressTotals

    folder = os.path.join(scratch, "totals")

    def event(batch, messages, late, symbol=None, at=None, run="r1"):
        own = {"messages": messages, "last_symbol": symbol, "last_price": 1.5, "last_time": at}
        return SimpleNamespace(progress=SimpleNamespace(batchId=batch, runId=run, observedMetrics={"trade_progress": own}, stateOperators=[SimpleNamespace(numRowsDroppedByWatermark=late)]))

    day = dt.datetime(2024, 1, 1)
    seen = []
    totals = ProgressTotals(spark, folder, every=100, report=seen.append)
    totals.onQueryProgress(event(0, 80, 1, "A", day))           # before it is known which run counts
    totals.follow(SimpleNamespace(runId="r1"))
    totals.onQueryProgress(event(1, 50, 2, "B", day + dt.timedelta(1)))
    totals.onQueryProgress(event(0, 999, 999, run="another"))
    again = ProgressTotals(spark, folder, every=100, report=seen.append)
    again.follow(SimpleNamespace(runId="r2"))
    again.onQueryProgress(event(1, 50, 2, "B", day + dt.timedelta(1), run="r2"))   # run again after a crash
    again.onQueryProgress(event(2, 200, 4, "C", day, run="r2"))     # its last time is older
    got = again.totals()
    assert (got["batch_id"], got["messages"], got["late_rows"], got["reports"], got["last_symbol"]) == (2, 330, 7, 3, "B")
    assert [r["messages"] for r in seen] == [130, 130, 330] and again.error is None

"""Plan properties: native expressions only, pruning/pushdown, one shuffle
for shared window frames, bounded top-k."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from marketlens.operators import arbitrage as ab
from marketlens.operators import indicators as ind
from marketlens.operators import rules as ru
from marketlens.operators import serving as sv
from marketlens.operators.stats import window_stats
from marketlens.plans.common import load_trades


def plan(df):
    df.write.format("noop").mode("overwrite").save()      # AQE: final plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_native_operators(spark):
    t = load_trades(spark, SF001)
    for df in (ab.arbitrage(t, "1 day"), ind.enrich(t), ind.live_indicators(t),
               ru.evaluate_rules(ind.enrich_for_rules(t)), window_stats(t)):
        p = plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_shared_window_frames_one_exchange(spark):
    t = load_trades(spark, SF001)
    p = plan(ind.enrich(t, block_rows=None))
    assert p.count("Exchange hashpartitioning") == 1
    assert p.count("Window [") >= 3


def test_blocked_frames_split_hot_symbol(spark):
    from marketlens.operators.frames import with_row_blocks
    t = load_trades(spark, SF001)
    b = with_row_blocks(t, halo=7, block_rows=100)
    real = b.filter(~F.col("_halo"))
    assert real.count() == t.count()                     # every row once
    assert real.groupBy("symbol").agg(
        (F.max("_pos") == F.count("*")).alias("dense")).filter(~F.col("dense")).count() == 0
    blocks = real.select("symbol", "_blk").distinct().count()
    assert blocks >= 10                                   # ~200 rows per symbol -> 2-3 blocks each
    halos = b.filter(F.col("_halo")).groupBy("symbol", "_blk").count()
    assert halos.count() == blocks - 5                    # every later block, no empty ones
    assert all(r["count"] == 7 for r in halos.collect())  # each gets the 7 rows before it
    p = plan(ind.enrich(t, block_rows=100))
    assert "_blk" in p


def test_column_pruning_and_pushdown(spark, scratch):
    t = load_trades(spark, SF001)
    p = plan(window_stats(t))
    scan = [line for line in p.split("\n") if "FileScan parquet" in line][0]
    assert "user_id" not in scan and "props" not in scan
    path = os.path.join(scratch, "trades")
    t.write.parquet(path)
    stored = spark.read.parquet(path)
    q = plan(ab.arbitrage(stored, "1 day", allow=["VIEW", "CLICK"]))
    assert "PushedFilters: [In(symbol" in q or "PushedFilters: [IsNotNull(symbol), In(symbol" in q


def test_topk_is_bounded(spark):
    t = load_trades(spark, SF001)
    assert "TakeOrderedAndProject" in plan(sv.recent_trades(t, 100))
    assert "WindowGroupLimit" in plan(sv.recent_per_symbol(t, 50))
    latest = plan(sv.latest_stats(window_stats(t)))
    assert "Window [" not in latest and "max_by" in latest


def test_block_offsets_join_keeps_partitioning(spark):
    """Without broadcasts the offsets join is a sort-merge join on the
    window's own partitioning columns: the large side is not re-shuffled."""
    from marketlens.operators.frames import with_row_blocks
    t = load_trades(spark, SF001)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        p = plan(with_row_blocks(t, block_rows=100))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    import re
    exchanges = [re.sub(r"#\d+L?", "", line) for line in p.split("\n")
                 if "Exchange hashpartitioning" in line]
    assert "SortMergeJoin" in p
    assert not any("coalesce(" in e or "isnull(" in e for e in exchanges)
    lines = p.split("\n")
    smj = [i for i, line in enumerate(lines) if "SortMergeJoin" in line]
    assert len(smj) == 1
    # the join's large (left) input is the rank window itself: no exchange
    # between them, its (_sk0, _sn0, _chunk) partitioning is reused
    assert "Window [row_number()" in lines[smj[0] + 1]


def test_latest_trade_sorts_nothing(spark, scratch):
    import datetime as dt
    path = os.path.join(scratch, "trades")
    load_trades(spark, SF001).write.parquet(path)
    stored = spark.read.parquet(path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in [None, *old]:                       # with broadcasts, then without
            if k:
                spark.conf.set(k, "-1")
            df = sv.latest_trade(stored)
            p = plan(df)
            assert "Sort [" not in p and "SortAggregate" not in p and "SortMergeJoin" not in p
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert any("GreaterThanOrEqual(ts" in line or ">= Subquery" in line or ">= ReusedSubquery" in line for line in p.split("\n"))
    t0 = dt.datetime(2024, 1, 1)
    rows = [("A", 1, t0, 1.0), ("A", 2, t0, 2.0), ("A", 2, t0, 2.0), ("B", 9, None, 3.0), ("B", 8, None, 4.0), (None, 1, t0, 5.0), ("C", None, t0, 6.0),
            ("D", 5, t0 + dt.timedelta(1), 7.0), ("D", 6, t0, 8.0), ("E", 1, t0, 9.0), ("E", 1, t0, 10.0)]
    got = sv.latest_trade(spark.createDataFrame(rows, "symbol string, event_id long, ts timestamp_ntz, price double")).collect()
    assert {(r.symbol, r.event_id) for r in got} == {("A", 2), ("B", 9), (None, 1), ("C", None), ("D", 5), ("E", 1)} and len(got) == 6

"""Latest-per-key buckets with a manifest, and alert records that survive replays."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from marketlens.streaming import latest, sinks

T0 = dt.datetime(2024, 1, 1)
STATS = "symbol string, avg_price double, window_start timestamp, window_end timestamp"


def batch(spark, rows):
    return spark.createDataFrame([(s, p, T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=h + 1)) for s, p, h in rows], STATS)


def newest(df):
    return df.groupBy("symbol").agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), "window_end").alias("r")).select("r.*")


def table(spark, path):
    return {r.symbol: r.avg_price for r in latest.read_by_key(spark, path).collect()}


def files(path):
    return {f: os.path.getsize(f) for f in glob.glob(path + "/parts/**/*.parquet", recursive=True)}


def test_only_touched_buckets_are_written(spark, scratch):
    path = scratch + "/latest"
    run = latest.upsert_by_key(path, newest, buckets=16)
    assert latest.read_by_key(spark, path) is None
    run(batch(spark, [(f"S{i}", float(i), 0) for i in range(400)]), 0)
    before = files(path)
    run(batch(spark, [("S7", 70.0, 5), ("S8", 80.0, -5), ("new", 1.0, 0)]), 1)
    written = {f: n for f, n in files(path).items() if f not in before}
    assert len(written) <= 3 and sum(written.values()) < sum(before.values()) / 3
    got = table(spark, path)
    assert len(got) == 401 and got["S7"] == 70.0 and got["S8"] == 8.0 and got["new"] == 1.0
    for k in range(2, 6):  # old manifests and the parts that they alone name go
        run(batch(spark, [("S7", 70.0 + k, 5 + k)]), k)
    assert len(os.listdir(path + "/manifests")) <= 2 + 2  # and their checksum files
    assert table(spark, path)["S7"] == 75.0 and len(table(spark, path)) == 401
    assert len([f for f in files(path)]) <= len(before) + 4


def test_a_crash_between_write_and_swap_keeps_the_old_state(spark, scratch, monkeypatch):
    path = scratch + "/latest"
    run = latest.upsert_by_key(path, newest, buckets=4)
    run(batch(spark, [("A", 1.0, 0), ("B", 2.0, 0)]), 0)
    whole = latest._Folder.write
    monkeypatch.setattr(latest._Folder, "write", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        run(batch(spark, [("A", 9.0, 4), ("C", 3.0, 0)]), 1)
    assert table(spark, path) == {"A": 1.0, "B": 2.0}
    monkeypatch.setattr(latest._Folder, "write", whole)
    run(batch(spark, [("A", 9.0, 4), ("C", 3.0, 0)]), 1)       # the batch runs again
    run(batch(spark, [("A", 9.0, 4), ("C", 3.0, 0)]), 1)       # and once more
    assert table(spark, path) == {"A": 9.0, "B": 2.0, "C": 3.0}
    run(batch(spark, []), 2)
    assert table(spark, path) == {"A": 9.0, "B": 2.0, "C": 3.0}


ALERT = "rule_name string, symbol string, message string, severity string, timestamp timestamp, data string, channels array<string>"


def test_a_replayed_batch_is_the_same_set_of_records(spark):
    rows = [("r", "A", "m", "HIGH", T0, '{"p":1}', ["kafka"])] * 2 + [("r", "B", "m", "HIGH", T0, '{"p":2}', ["kafka"]), ("q", None, "m", "LOW", T0, None, ["kafka"])]
    later = [(*r[:4], T0 + dt.timedelta(hours=1), *r[5:]) for r in reversed(rows)]  # another order and time
    send = lambda own, name: sinks.alerts_to_kafka(spark.createDataFrame(own, ALERT).repartition(3), "t", name)
    ids = lambda df: sorted(bytes(r.headers[0].value).decode() for r in df.collect())
    once, again, next_batch = send(rows, "q:1"), send(later, "q:1"), send(rows, "q:2")
    assert ids(once) == ids(again) and len(set(ids(once))) == 4 and not set(ids(once)) & set(ids(next_batch))
    kept = sinks.unique_records(once.unionByName(again).unionByName(next_batch))
    assert ids(kept) == sorted(ids(once) + ids(next_batch))
    bare = sinks.alerts_to_kafka(spark.createDataFrame(rows, ALERT), "t")
    assert bare.columns == ["topic", "key", "value"]
    unnamed = bare.withColumn("headers", F.lit(None).cast("array<struct<key:string,value:binary>>"))
    assert sinks.unique_records(unnamed).count() == 4


def test_unique_records_on_a_stream(spark, scratch):
    rows = [("r", s, "m", "HIGH", T0, "{}", ["kafka"]) for s in "ABC"]
    sent = sinks.alerts_to_kafka(spark.createDataFrame(rows, ALERT), "t", "q:1").withColumn("timestamp", F.lit(T0).cast("timestamp"))
    for _ in range(2):
        sent.coalesce(1).write.mode("append").parquet(scratch + "/in")
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(scratch + "/in")
    q = (sinks.unique_records(stream, "1 hour").writeStream.format("parquet").option("path", scratch + "/out")
         .option("checkpointLocation", scratch + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(scratch + "/out").collect()) == ["A", "B", "C"]

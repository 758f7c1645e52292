"""The replay of late rows: its micro-batches do not follow the days of the table, and a
file that arrives is read alone."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_util import duck, multiset, oracle_table
from marketlens.plans import q_streams as qs

T0 = dt.datetime(2024, 1, 1)


def files(spark, days):
    day = spark.range(days).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int), 7)").alias("ts"))
    first, last = (F.lit(T0 + dt.timedelta(days=d)).cast("timestamp_ntz") for d in (0, days - 1))
    return [r.f for r in day.select("id", qs._late_file("ts", first, last).alias("f")).orderBy("id").collect()]


def test_files_of_a_month_and_of_years(spark):
    assert files(spark, 30) == [d // 3 for d in range(30)]
    assert max(files(spark, 400)) < qs.FILES
    years = files(spark, 10_800)
    assert years == sorted(years) and years[:7] == [0, 0, 0, 1, 1, 1, 2]
    assert max(years) < 200 and max(map(years.count, set(years))) <= qs.MOST_DAYS


def test_late_rows_of_years(spark, tmp_path, monkeypatch):
    made = []
    arrive = qs._Replay.arrive
    monkeypatch.setattr(qs._Replay, "arrive", lambda self, n: (made.append(self.files), arrive(self, n)))
    rows = [{"event_id": i, "ts": T0 + dt.timedelta(days=i * 0.5, seconds=i), "user_id": i % 7, "event_type": "click", "value": 1.0 + i % 9, "props": "{}"} for i in range(700)]
    rows += [{**rows[-1], "event_id": 725, "ts": None}]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "events.parquet")
    found = entry.queries()["stream_late_rows"](spark, str(tmp_path)).toArrow()
    assert multiset(found) == multiset(oracle_table(duck(str(tmp_path)), entry.oracle_sql()["stream_late_rows"]))
    assert max(made) <= qs.FILES


@pytest.mark.parametrize("part", [None, "own"])
def test_a_file_is_read_alone(spark, part):
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, F.col("id") % 4).cast("int").alias("own"))
    replay = qs._Replay(rows, ["id"], files=4, part=part)
    plan = replay.staged.where("_file = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_file" in plan
    replay.arrive(3)
    got = spark.read.parquet(replay.path)
    assert got.columns == ["id", "own"]
    assert sorted(r.id for r in got.collect()) == (list(range(75)) if part is None else [i for i in range(90) if i % 4 < 3])

"""The keyed-state streams in a session that has set nothing for them: Spark's default
state store has no column families, and the driver's Python worker does not find the library."""

import datetime as dt
import random
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle

import __spark_entry__ as entry
from oracle_util import duck, multiset, oracle_table
from marketlens.streaming import sinks, stateful


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng, folder = random.Random(5), tmp_path_factory.mktemp("tables")
    at = sorted(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.uniform(0, 20 * 86400)) for _ in range(400))
    rows = [{"event_id": i, "ts": t, "user_id": rng.randrange(50), "event_type": rng.choice(["click", "view"]),
             "value": round(rng.uniform(1, 200), 2), "props": "{}"} for i, t in enumerate(at)]
    pq.write_table(pa.Table.from_pylist(rows), folder / "events.parquet")
    return str(folder)


@pytest.fixture()
def plain(spark):
    own = spark.conf.get(sinks.STORE, None)
    spark.conf.set(sinks.STORE, sinks.PLAIN_STORE)
    yield spark
    assert spark.conf.get(sinks.STORE) == sinks.PLAIN_STORE
    spark.conf.set(sinks.STORE, own) if own else spark.conf.unset(sinks.STORE)


@pytest.mark.parametrize("name", ["stream_indicators", "stream_indicators_watermark", "stream_alert_latch"])
def test_query_in_a_session_with_the_default_store(plain, tables, name):
    found = entry.queries()[name](plain, tables).toArrow()
    assert len(found) > 0
    assert multiset(found) == multiset(oracle_table(duck(tables), entry.oracle_sql()[name]))


def test_a_store_that_the_session_names_stays(spark):
    own = spark.conf.get(sinks.STORE, None)
    for name, inside in ((sinks.PLAIN_STORE, sinks.ROCKSDB_STORE), ("my.Store", "my.Store")):
        spark.conf.set(sinks.STORE, name)
        with sinks.keyed_state(spark):
            assert spark.conf.get(sinks.STORE) == inside
        assert spark.conf.get(sinks.STORE) == name
    spark.conf.set(sinks.STORE, own) if own else spark.conf.unset(sinks.STORE)


@pytest.mark.parametrize("processor", [stateful._Indicators(None), stateful._Sorted(["a"], ["a"]), stateful._Released(["a"], ["a"], "UTC"),
                                       stateful._Crossings(), stateful._Counter()], ids=lambda p: type(p).__name__)
def test_processors_load_where_the_library_is_not(processor):
    code = "import pickle, sys; p = pickle.load(sys.stdin.buffer); p.handleInputRows; assert 'marketlens' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(processor), cwd="/", check=True, env={"PYTHONPATH": ""})

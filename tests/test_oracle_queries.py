"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import pytest

import __spark_entry__ as entry
from oracle_util import duck, multiset, oracle_table
from conftest import SF001

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF001).toArrow()
    odf = oracle_table(con, ORACLES[name])
    sc, srows = multiset(sdf)
    oc, orows = multiset(odf)
    assert sc == oc
    assert len(sdf) == len(odf)
    assert srows == orows


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["symbol", "window_start", "window_end", "avg_price", "min_price",
                          "max_price", "trade_count", "volatility", "trend"]


def test_every_query_runs(spark):
    for name, fn in entry.queries().items():
        df = fn(spark, SF001)
        assert df.schema is not None, name

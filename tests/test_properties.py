"""Properties: min <= avg <= max; 0 <= RSI <= 100; buy venue !=
sell venue and percentage above the minimum; dashboard RSI in [0, 100]."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketlens.operators import arbitrage as ab
from marketlens.operators import indicators as ind
from marketlens.operators.stats import window_stats
from test_operators import TRADE

T0 = datetime(2024, 1, 1)

trade_lists = st.lists(
    st.tuples(st.sampled_from(["A", "B", "C"]), st.floats(0.01, 1000, allow_nan=False),
              st.integers(0, 3600), st.sampled_from(["x", "y", "z"]),
              st.sampled_from([0.0, 0.5, 1.0, 3.0])),
    min_size=1, max_size=120)

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _df(spark, rows):
    return spark.createDataFrame(
        [(i, s, ex, float(p), v, T0 + timedelta(seconds=sec))
         for i, (s, p, sec, ex, v) in enumerate(rows)], TRADE)


@SETTINGS
@given(rows=trade_lists)
def test_stats_and_indicator_bounds(spark, rows):
    t = _df(spark, rows)
    for r in window_stats(t, "10 minutes").collect():
        assert r.min_price <= r.avg_price * (1 + 1e-12) and r.avg_price <= r.max_price * (1 + 1e-12)
        assert r.trade_count >= 1
    for r in ind.enrich(t, block_rows=40).collect():
        assert r.rsi is None or -1e-9 <= r.rsi <= 100 + 1e-9
    for r in ind.live_indicators(t, block_rows=None).collect():
        assert 0 <= r.live_rsi <= 100


@SETTINGS
@given(rows=trade_lists)
def test_arbitrage_invariants(spark, rows):
    for r in ab.arbitrage(_df(spark, rows), "15 minutes").collect():
        assert r.buy_exchange != r.sell_exchange
        assert r.buy_price < r.sell_price
        assert r.arbitrage_percentage > 0.5
        assert r.potential_volume > 0

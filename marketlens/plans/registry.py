"""Registry of named queries: ``name -> (spark_fn(spark, sf_dir), oracle_sql)``.

Each query reads the driver tables whole (no id subsets, no row caps; a
``limit`` appears only where top-k *is* the operator).  Oracle SQL is
DuckDB over the same Parquet tables (views named after the tables).
Floating columns produced by sums/means/stddevs are rounded to 6 digits on
*both* sides, because summation order differs between engines in the last
bits; nothing else is normalised.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def query_names() -> list[str]:
    _load()
    return list(QUERIES)


_LOADED = False


def _load():
    global _LOADED
    if not _LOADED:
        # importing the modules registers their queries
        from marketlens.plans import q_stats, q_serving  # noqa: F401
        for mod in ("q_indicators", "q_arbitrage", "q_alerts", "q_parse", "q_streams"):
            try:
                __import__(f"marketlens.plans.{mod}")
            except ModuleNotFoundError as exc:
                if exc.name != f"marketlens.plans.{mod}":
                    raise
        _LOADED = True


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)

from marketlens.sources.tables import (
    load_table, load_trades, trades_from_events, trades_from_lineitem,
    TRADE_COLUMNS,
)
from marketlens.sources.streams import (
    SourceConfig, read_trades_stream, read_unified_stream, read_raw_stream,
)

__all__ = [
    "load_table", "load_trades", "trades_from_events", "trades_from_lineitem",
    "TRADE_COLUMNS", "SourceConfig", "read_trades_stream",
    "read_unified_stream", "read_raw_stream",
]

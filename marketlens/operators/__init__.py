"""DataFrame -> DataFrame operators: statistics (A1, A2, W13), ordered row
blocks, indicators (W1-W12), arbitrage (A3-A8), rules (R1-R8, S9), user
alerts (L1-L7) and serving queries (A9-A16, O1-O5)."""

"""Structured Streaming: sinks (S4-S9, S11), stream jobs (T1-T8, T11) and
keyed-state processors (T9, T10)."""

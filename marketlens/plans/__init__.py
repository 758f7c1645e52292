from marketlens.plans.registry import QUERIES, ORACLES, query_names

__all__ = ["QUERIES", "ORACLES", "query_names"]

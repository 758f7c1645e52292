"""Training-data operators: ten stages of a text-corpus pipeline on Spark.

Nothing outside this package imports it.  Each module holds one operator with
its own interface; ``queries`` registers the thin ``opN_<name>`` queries that
apply an operator to a whole table and return its digest columns.
"""

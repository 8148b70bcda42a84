"""Fixtures derived from the driver's tables and the registered queries.

:mod:`shoppulse.plans.fixtures` builds the inputs the reference's scripts read
(wide behaviour table, labelled documents, raw response bodies) from the given
parquet tables with Spark, and :mod:`shoppulse.plans.catalog` registers every
query with its DuckDB oracle text.
"""

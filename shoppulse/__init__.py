"""shoppulse: PySpark DataFrame operators for consumer-data mining.

Three chains, all expressed with the DataFrame API so Catalyst plans them:

* text mining over reviews / Q&A (extraction, cleaning, tokens, term
  frequency, TF-IDF, association rules, topics),
* cohort targeting over wide behaviour tables (sampling, ratios, feature
  selection, Spark ML model search, weighted ensembles, out-of-fold scores),
* correlation-driven labelling (pair correlations, signed weights, weighted
  scores, evaluation reports).

Sub-packages:
    sources    readers and writers (CSV/parquet/text in, CSV/parquet out)
    functions  column expressions (no DataFrame in, Column out)
    operators  DataFrame -> DataFrame operators
    plans      fixtures derived from the test tables and the registered queries
    streaming  (empty on purpose, see its docstring)
"""

from shoppulse.session import get_session, checkpoint_dir, broadcast_if_small

__all__ = ["get_session", "checkpoint_dir", "broadcast_if_small"]

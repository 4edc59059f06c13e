"""lectio: reading-time analytics as Spark DataFrame plans.

Sub-packages
------------
sources    readers and writers (CSV/TSV, per-document token tables, raw lines, JSON maps)
functions  native column expressions (tokenising, counting, truncation, argmax)
operators  DataFrame -> DataFrame operators (features, alignment, mixed model,
           folds, regressors, embeddings, sequence encoding, metrics)
plans      end-to-end plans (cross-validation), derived input views, query registry
streaming  incremental ingest of per-document token tables
"""

__version__ = "0.1.0"

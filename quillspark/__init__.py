"""A Spark-first engine for versioned text corpora: ingest, retrieval, evaluation, data preparation."""

__version__ = "0.1.0"

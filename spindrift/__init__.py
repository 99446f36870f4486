"""Spark-native container-log analytics: filters, selectors, ingest folds, catalog and search as DataFrame plans."""

__version__ = "0.1.0"

"""Hybrid retrieval over namespaced document and code corpora, as Spark jobs."""

__version__ = "0.1.0"

"""Tessera: a Spark-native full-text retrieval engine."""

__version__ = "0.1.0"

"""Spark-native hybrid search, findings gate and data-processing engine."""

__version__ = "0.1.0"

"""Spark-native analytics for large bodies of structured text."""

__version__ = "0.1.0"

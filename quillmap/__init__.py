"""Spark-native analytics over large collections of scholarly works."""

__version__ = "0.1.0"

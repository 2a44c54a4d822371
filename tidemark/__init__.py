"""Spark-native analytics for marine and coastal point-of-interest data."""

__version__ = "0.1.0"

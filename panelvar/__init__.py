"""Spark-native analytics for panels of daily market and macro-economic series."""

__version__ = "0.1.0"

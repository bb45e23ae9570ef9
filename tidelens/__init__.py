"""Spark-native market, portfolio and sentiment analytics."""

__version__ = "0.1.0"

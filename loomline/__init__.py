"""A Spark-native engine for source-line analytics."""

__version__ = "0.2.0"

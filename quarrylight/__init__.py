"""Quarrylight: a Spark-native engine over code repositories and text corpora."""

__version__ = "0.1.0"

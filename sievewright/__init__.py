"""Spark-native curation and analysis of text and source-code corpora."""

__version__ = "0.1.0"

"""Spark-native preparation of structured data for language-model prompts."""

__version__ = "0.1.0"

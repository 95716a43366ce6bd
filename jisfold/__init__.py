"""Spark-native canonicalisation of Japanese text."""

__version__ = "0.1.0"
__version_tuple__ = (0, 1, 0)

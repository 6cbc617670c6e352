"""Spark-native analytics over adversarial and training text."""

__version__ = "0.1.0"

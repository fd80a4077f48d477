"""Spark-native analytics for program variants, their runs and the text around them."""

__version__ = "0.1.0"

"""Spark-native media analytics: rasters, audio, timed text and containers as DataFrames."""

__version__ = "0.1.0"

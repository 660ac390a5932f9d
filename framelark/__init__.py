"""Spark-native operators for frame-rate signals, note events and model scores."""

__version__ = "0.1.0"

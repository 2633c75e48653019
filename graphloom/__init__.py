"""Spark-native analytics over code graphs, vectors and documents."""

__version__ = "0.1.0"

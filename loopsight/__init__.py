"""Spark-native analytics for periodic image sequences of a moving surface."""

"""Spark-native learning and analysis of mixed tabular data."""

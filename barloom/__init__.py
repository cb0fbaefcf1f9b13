"""Spark-native bar-data and trade analytics."""

"""Spark-native analytics for used-vehicle markets."""

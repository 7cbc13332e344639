"""Spark-native analytics for tender-style documents and line-item tables."""

"""Spark-native open-set vector retrieval analytics."""

"""Spark-native hybrid search and record analytics."""

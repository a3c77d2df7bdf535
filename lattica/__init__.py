"""Spark-native engine for large sparse matrices, block vectors and directed graphs."""

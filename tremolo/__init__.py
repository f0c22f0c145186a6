"""Spark-native signal diagnosis and corpus processing."""

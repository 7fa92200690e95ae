"""Tidemark: a Spark-native engine that explains why business measures move."""

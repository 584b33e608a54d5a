"""Tidebook: a Spark-native engine for event-ordered market data and training-data pipelines."""

"""Spark-native analytics for evaluating text-producing models at scale."""

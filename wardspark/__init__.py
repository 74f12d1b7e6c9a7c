"""Spark-native analytics for governing the use of AI assistants."""

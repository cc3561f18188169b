"""Spark-native analytics for event-driven text-and-market research."""

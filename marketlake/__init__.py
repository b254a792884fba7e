"""Spark-native analytics for market ticks, in batch and in Structured Streaming."""

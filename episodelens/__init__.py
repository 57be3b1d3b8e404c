"""Spark-native analytics for episode-structured time series."""

"""Spark-native analytics for repeated-measures behavioural time series."""

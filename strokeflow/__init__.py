"""Spark-native engine for tracked-object and event time series."""

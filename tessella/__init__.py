"""Spark-native data selection, selection analytics and corpus preparation."""

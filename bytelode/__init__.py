"""Spark-native analytics over byte evidence."""

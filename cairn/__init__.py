"""Spark-native point-of-interest curation engine."""

"""Spark-native document corpus and classifier-measurement engine."""

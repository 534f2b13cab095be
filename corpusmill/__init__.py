"""Spark-native curation and evaluation analytics for language-model training data."""

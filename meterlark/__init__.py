"""Spark-native analytics for metered usage, quota windows and training-data corpora."""

"""Spark-native review-integrity analytics and training-data operators."""

"""Spark-native analytics for multilingual narrative corpora."""

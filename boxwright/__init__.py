"""Spark-native curation of detection tables, with a corpus toolkit beside it."""

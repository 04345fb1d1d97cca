"""Corpus operators for training-data pipelines. Nothing outside imports this."""

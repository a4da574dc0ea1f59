"""Operators for training-data corpora. Nothing outside this package and `corpus_pipeline` imports it."""

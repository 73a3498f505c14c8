"""Corpus operators for training-data pipelines. Nothing else in kerbline imports this package."""

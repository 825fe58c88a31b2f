"""Operators for preparing training data from very large corpora."""

"""Corpus operators for training data."""

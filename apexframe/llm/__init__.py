"""Operators and queries of the training-data pipeline."""

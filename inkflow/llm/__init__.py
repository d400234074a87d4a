"""Operators for training-data pipelines. Nothing else in inkflow imports this package."""

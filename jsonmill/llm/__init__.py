"""Operators for large training-text pipelines.  Nothing else in jsonmill imports this package."""

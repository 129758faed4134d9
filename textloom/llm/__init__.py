"""Operators for large-scale training data. Nothing else in textloom imports this package."""

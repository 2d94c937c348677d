"""Operators for preparing model training data; nothing else in the library imports this package."""

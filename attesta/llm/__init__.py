"""Operators for preparing training data. Self-contained: the rest of the package doesn't import this."""

"""Operators for preparing training data; nothing outside imports this package."""

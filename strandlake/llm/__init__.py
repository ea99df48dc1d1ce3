"""Operators for preparing training corpora at scale. Nothing else in the library imports this package."""

"""Operators for preparing training data. Nothing else in quirefold imports this package."""

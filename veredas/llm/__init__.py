"""Operators for building language-model training data."""

"""Operators for building training data out of code, reviews and findings."""

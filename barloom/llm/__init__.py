"""Operators for building training data from document tables."""

"""Operators for the preparation of training text, vectors and pages."""

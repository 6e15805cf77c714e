"""Policies and the patterns that they compile to."""

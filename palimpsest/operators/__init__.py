"""Operators on DataFrames of objects, files, matches and queue items."""

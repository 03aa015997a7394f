"""Operators for large training-text tables, and their registered queries.

Nothing else in the library imports this package.
"""

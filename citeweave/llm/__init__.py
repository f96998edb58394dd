"""Operators for building language-model training data, one module each.

Nothing else in the library imports this package; ``queries.py`` lists its queries.
"""

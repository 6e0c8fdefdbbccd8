"""Operators for building training data from a large text corpus.

Nothing else in the library imports this subpackage.
"""

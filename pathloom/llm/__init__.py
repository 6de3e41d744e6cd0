"""Operators for large text-corpus pipelines.

Nothing else in the library imports this subpackage; it can be removed whole.
"""

"""Operators that prepare text collections for training language models.

Nothing else in the package imports this one; it can be deleted whole.
"""

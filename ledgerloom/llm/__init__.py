"""Operators for training-data preparation on very large text collections.

Nothing else in the library imports this subpackage.
"""

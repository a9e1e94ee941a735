"""Operators for preparing training data: each module holds one operator of the list in the README.

Nothing else in the library imports this subpackage.
"""

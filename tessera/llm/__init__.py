"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it can be removed whole.
Each module holds one operator with a general interface, and the query that
applies it to a table of the test data.
"""

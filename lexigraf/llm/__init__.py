"""Operators for preparing training corpora, one module each.

Nothing else in the library imports this subpackage; it imports nothing else
from the library.  ``registry`` lists the queries and their SQL.
"""

"""Operators of a training-data pipeline over the ``documents`` table.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` holds the thin
registered queries.
"""

"""Operators for training-data pipelines over a ``documents`` table.

One module per operator (general interface), ``queries.py`` with the thin
registered queries. Nothing else in the library imports this subpackage.
"""

"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; `queries.py` holds the thin queries that apply them to the tables.
"""

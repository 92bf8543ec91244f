"""Operators for large-scale training-data pipelines.

Each module holds one operator (DataFrame in, DataFrame out); `queries.py`
registers one query per operator.  Nothing else in the library imports this
subpackage.
"""

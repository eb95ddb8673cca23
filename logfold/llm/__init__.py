"""Operators for preparing text to train language models on.

Nothing outside this package imports it; its queries are in ``queries.py``.
"""

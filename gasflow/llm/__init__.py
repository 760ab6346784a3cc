"""Operators for preparing training text, their queries (``queries.py``) and SQL.

Nothing else in the library imports this subpackage.
"""

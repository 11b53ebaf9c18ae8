"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
``opN_<name>`` queries and their DuckDB counterparts.
"""

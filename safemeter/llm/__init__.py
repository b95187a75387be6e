"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries.py`` holds the thin ``opN_<name>`` queries that
``__spark_entry__`` registers.
"""

"""Operators for preparing training data, each over whole tables.

Nothing outside this package imports it.  ``registry`` names the queries.
"""

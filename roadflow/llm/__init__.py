"""Training-data operators: packing, deduplication, scoring, search, filters.

Nothing else in the library imports this subpackage.  Each operator module
exposes a general interface; the thin registered queries are in ``registry``.
"""

"""Training-data operators: deduplication, search, mixing, scoring, tokenising and filters.

Nothing outside this subpackage imports it. ``queries.py`` registers the thin
``opN_*`` queries; every other module holds one operator with its own interface.
"""

"""Training-data operators (search, dedup, scoring, filtering, mixing).

Nothing else in the library imports this subpackage; it can be deleted whole.
"""

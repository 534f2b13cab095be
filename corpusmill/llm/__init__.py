"""Training-data operators: deduplication, scoring, mixing, packing, search, secrets and web archives.

Nothing else in the package imports this subpackage.
"""

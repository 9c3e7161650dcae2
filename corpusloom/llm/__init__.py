"""Training-data operators: packing, tokenising, filtering, deduplication, sharding and scoring.

Nothing outside this subpackage imports it.
"""

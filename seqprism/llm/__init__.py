"""Training-data operators: sharding, packing, tokenising, filtering and de-duplication.

Nothing outside this subpackage imports it.
"""

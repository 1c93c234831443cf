"""Training-data operators: scoring, filtering, deduplication, packing, search, sharding and archives.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""

"""Training-data operators: joins, dedup, mixing, scrubbing and sharding of document tables.

Nothing outside this subpackage imports it.
"""

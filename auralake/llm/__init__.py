"""Training-data operators: scoring, filtering, deduplication, sharding, archives and token ids.

Nothing outside this package imports it. ``queries`` holds the registered queries and their SQL.
"""

"""Training-data operators: text, media, deduplication, classification, sharding and packing.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin registered queries,
every other module one operator with its own general interface.
"""

"""Training-data operators: cleaning, scoring, mixing, deduplication, sharding.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where it can be imported.
"""

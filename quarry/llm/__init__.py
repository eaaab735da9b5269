"""Training-data operators: sharding, scoring, deduplication, search, mixing, packing and extraction."""

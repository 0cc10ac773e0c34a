"""Training-data operators: scoring, search, scanning, mixing, packing, sharding, filtering and deduplication."""

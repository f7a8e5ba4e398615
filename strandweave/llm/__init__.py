"""Training-data operators: deduplication, sharding, tokenising, packing, scoring and media features."""

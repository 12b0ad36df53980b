"""Training-data operators: sharding, deduplication, mixing, packing and the like."""

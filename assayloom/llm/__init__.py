"""Training-data operators: sharding, filtering, deduplication, encoding and packing of document tables."""

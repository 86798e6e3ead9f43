"""Training-data operators: extraction, scoring, deduplication, mixing, sharding, search, tokenising."""

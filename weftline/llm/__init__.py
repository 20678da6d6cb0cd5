"""Training-data operators: sharding, scoring, language, extraction, duplicates, mixing, packing."""

"""Training-data operators: deduplication, quality, mixing, language, search, packing."""

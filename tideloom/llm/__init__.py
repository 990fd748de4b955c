"""Training-data operators: tokenization, deduplication, extraction, filtering, packing."""

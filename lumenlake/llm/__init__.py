"""Training-data operators: tokenisation, packing, deduplication, filtering, formatting and search."""

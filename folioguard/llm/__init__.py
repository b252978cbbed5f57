"""Training-data operators: deduplication, filtering, scoring, archives and packing."""

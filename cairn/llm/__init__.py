"""Training-data operators: formatting, deduplication, packing, filtering, tokenising, archives."""

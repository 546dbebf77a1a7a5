"""Training-data operators (mixing, search, dedup, packing, filters, formatting)."""

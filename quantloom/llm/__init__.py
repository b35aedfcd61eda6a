"""Training-data operators: extraction, dedup, scoring, search, tokens and packing."""

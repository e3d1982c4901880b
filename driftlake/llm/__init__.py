"""Training-data operators: deduplication, archives, scans, tokenisation, scoring and packing."""

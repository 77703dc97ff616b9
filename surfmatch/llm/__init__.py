"""Training-data operators: extraction, scanning, deduplication, packing, filtering."""

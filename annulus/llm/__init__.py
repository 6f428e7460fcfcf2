"""Training-data operators: deduplication, packing, search, classification, scanning and tokenising."""

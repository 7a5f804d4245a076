"""Training-data operators: scoring, deduplication, mixing, scanning and packing of documents."""

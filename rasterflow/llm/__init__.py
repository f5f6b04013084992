"""Training-data operators: tokenising, deduplication, filtering, scanning and packing of text corpora."""

"""Training-data operators: quality, deduplication, scanning, token counting."""

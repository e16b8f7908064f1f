"""Training-data pipeline operators: filtering, deduplication, mixing, packing and token counting."""

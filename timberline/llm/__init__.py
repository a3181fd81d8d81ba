"""Training-data operators: filters, near and exact deduplication, mixing, and token output."""

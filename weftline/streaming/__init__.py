"""Structured Streaming variants (an extra beyond the batch operators)."""

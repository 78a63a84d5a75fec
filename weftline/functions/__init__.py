"""Column-level functions: text, hashing, JSON, masking."""

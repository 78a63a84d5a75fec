"""Readers and writers for JSONL corpora, manifests and split exports."""

"""Buffered and streaming ingest."""

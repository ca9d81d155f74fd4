"""Ingest-time transforms, inference, shredding, ingest and adaptive layout."""

"""Structured Streaming jobs (incremental ingest, flag transitions)."""

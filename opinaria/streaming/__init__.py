"""Structured Streaming versions of the ingestion sink."""

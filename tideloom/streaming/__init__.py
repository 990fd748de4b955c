"""Structured Streaming forms of the ingest and bar operators."""

"""Incremental (Structured Streaming) loading of order files."""

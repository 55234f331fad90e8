"""Incremental runs on Structured Streaming (an extension)."""

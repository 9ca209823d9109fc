"""Structured Streaming forms of the folder watch, the caches and the sessions."""

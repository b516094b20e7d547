"""Structured Streaming forms of the maintenance jobs."""

"""Structured Streaming forms of the application jobs."""

"""Structured Streaming forms of collection and source health."""

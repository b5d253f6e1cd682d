"""Readers of listings, feeds, law APIs and configuration."""

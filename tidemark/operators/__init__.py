"""Relational operators: collection, selection, gating, messages, health, storage and delivery."""

"""Structured Streaming forms of the additive cells."""

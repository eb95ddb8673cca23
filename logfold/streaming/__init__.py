"""Structured Streaming over recordings and event tables."""

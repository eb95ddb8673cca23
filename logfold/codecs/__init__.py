"""Payload codecs."""

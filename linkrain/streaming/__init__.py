"""Streaming of the link engine."""

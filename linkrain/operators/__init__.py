"""Operators of the link engine."""

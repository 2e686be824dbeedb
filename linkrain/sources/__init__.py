"""Sources of the link engine."""

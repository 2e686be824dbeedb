"""Plans of the link engine."""

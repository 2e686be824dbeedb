"""Functions of the link engine."""

"""operators of the drainage engine."""

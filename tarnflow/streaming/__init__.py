"""streaming of the drainage engine."""

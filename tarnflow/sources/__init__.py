"""sources of the drainage engine."""

"""functions of the drainage engine."""

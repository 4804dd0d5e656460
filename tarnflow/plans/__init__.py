"""plans of the drainage engine."""

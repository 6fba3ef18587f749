"""Column builders and parameter checks."""

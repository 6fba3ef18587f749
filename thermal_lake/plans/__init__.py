"""Queries over the driver tables, with the SQL that says the same, and whole pipelines."""

"""Composite queries and their registry."""

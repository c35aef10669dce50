"""Queries over streams."""

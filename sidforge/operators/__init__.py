"""Distributed operators on items, vectors and codes."""

"""Composed analyses (the reference's end-to-end paths) and the query catalog."""

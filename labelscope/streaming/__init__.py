"""Streaming entry points (the reference has no streaming; see README)."""

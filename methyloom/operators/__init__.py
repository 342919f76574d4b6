"""Relational operators of the calling pipeline."""

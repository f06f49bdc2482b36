"""Scores for documents that arrive over time."""

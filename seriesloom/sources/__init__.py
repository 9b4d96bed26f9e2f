"""Readers of landed data, and written tables."""

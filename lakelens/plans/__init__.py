"""Guarded SQL."""

"""Operators of quarry."""

"""Streaming of quarry."""

"""Plans of quarry."""

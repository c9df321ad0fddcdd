"""Column functions: Catalyst expressions only, no Python per row."""

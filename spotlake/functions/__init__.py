"""Column functions: frequencies, calls, lines."""

"""Column-producing functions and metrics."""

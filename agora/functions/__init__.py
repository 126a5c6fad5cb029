"""Column helpers and the exact distributed percentile."""

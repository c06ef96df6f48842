"""Column functions and the exact rank percentile."""

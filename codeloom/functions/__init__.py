"""Column builders and driver-side scalar functions."""

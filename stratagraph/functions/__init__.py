"""Column functions, and their registration as SQL functions."""

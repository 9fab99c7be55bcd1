"""Column functions and pure Python functions."""

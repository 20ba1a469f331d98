"""Column functions and byte kernels."""

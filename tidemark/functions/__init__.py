"""Column functions: scalars, arrays and rolling windows."""

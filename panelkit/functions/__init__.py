"""Column functions: missing values, guarded arithmetic, rolling and cross-sectional windows."""

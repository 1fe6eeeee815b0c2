"""Column functions: every name takes columns and returns a column."""

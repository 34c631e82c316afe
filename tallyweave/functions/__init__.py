"""Column functions: text, time, units, geography and nested values."""

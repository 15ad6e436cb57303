"""Reusable DataFrame operators. Each takes and returns DataFrames and uses only
built-in expressions; none collects data to the driver."""

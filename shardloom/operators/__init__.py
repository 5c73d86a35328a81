"""Operators on DataFrames of sharded rows."""

"""Operators on DataFrames: cleaning, roll-ups, table builders, snapshot diffs, the read API."""

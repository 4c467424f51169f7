"""Operators of the memory model: DataFrames in, DataFrames out, ``now`` always a parameter, no actions inside."""

"""Operators over alignment tables; each takes and returns DataFrames."""

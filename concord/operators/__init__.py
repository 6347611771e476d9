"""Relational operators of document reconciliation; each takes and returns DataFrames."""

"""Relational and retrieval operators; every one takes and returns DataFrames."""

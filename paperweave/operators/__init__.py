"""Relational operators over DataFrames (one module per family)."""

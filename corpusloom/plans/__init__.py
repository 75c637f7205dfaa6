"""Typed retrieval plans: specification, checks, builder, and their lowering to DataFrames."""

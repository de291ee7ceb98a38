"""Logical queries, their front ends and their compilation to DataFrames."""

"""Logical types, literals and value semantics."""

"""Predicates and aggregates as column expressions."""

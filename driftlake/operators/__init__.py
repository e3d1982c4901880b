"""Operators over measurement tables: one row is one measurement of a series."""

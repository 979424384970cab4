"""Operators of the audit library."""

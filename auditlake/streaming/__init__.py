"""Streaming of the audit library."""

"""Functions of the audit library."""

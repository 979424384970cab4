"""Sources of the audit library."""

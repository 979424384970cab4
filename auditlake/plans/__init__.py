"""Plans of the audit library."""

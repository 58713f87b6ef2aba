"""Column functions; all are Catalyst expressions."""

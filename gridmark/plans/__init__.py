"""Registered queries over the driver's tables, by family."""

"""Queries over the driver's tables, each with the SQL that states the same result."""

"""Dialects, the domain views over the driver's tables, and the registry of queries."""

"""Operators of the market engine, by subject; importing a module registers its queries."""

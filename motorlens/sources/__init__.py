"""Readers of listing sources (files in, rows out)."""

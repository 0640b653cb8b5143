"""Diagnostics over one table, or over a reference and a current table."""

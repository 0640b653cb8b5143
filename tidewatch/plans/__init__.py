"""Budgets, configuration and the whole-table analysis plan."""

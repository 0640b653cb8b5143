"""Readers that turn any input into a Spark DataFrame, and writers for results."""

"""Structured Streaming front end over the batch operators."""

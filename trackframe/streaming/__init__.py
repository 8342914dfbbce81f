"""Structured Streaming forms of the order-dependent operators."""

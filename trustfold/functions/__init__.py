"""Metrics, closed forms and durable tables."""

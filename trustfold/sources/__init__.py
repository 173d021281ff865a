"""Inputs other than plain tables."""

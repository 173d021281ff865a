"""Trustworthy model evaluation on Spark DataFrames."""

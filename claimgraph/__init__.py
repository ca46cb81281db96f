"""Canonical records, claim topology and mapping analysis on Spark DataFrames."""

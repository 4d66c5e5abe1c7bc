"""Operators on DataFrames; each names the survey's ids that it covers."""

"""Operators: functions from DataFrames to DataFrames, for many keys at once."""

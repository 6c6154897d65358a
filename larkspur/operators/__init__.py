"""Operators: functions from DataFrames and plain parameters to DataFrames."""

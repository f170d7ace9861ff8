"""Operators: functions from DataFrames and keyword parameters to DataFrames."""

"""Relational operators of record resolution: functions from DataFrames to DataFrames."""

"""Operators: functions from DataFrames to DataFrames, parameterised by column names."""

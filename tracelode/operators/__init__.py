"""Operators: functions of DataFrames that return DataFrames."""

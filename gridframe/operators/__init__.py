"""Operators: functions from Spark DataFrames to Spark DataFrames, lazy unless they say otherwise."""

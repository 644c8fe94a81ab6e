"""Analytic operators: functions from DataFrames to DataFrames, lazy, with ``today`` passed in."""

"""Operators on DataFrames: clocks, repair, resampling, windows, joins, features, detection, evaluation."""

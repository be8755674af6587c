"""Captures on disk to DataFrames and back, and the grading of their sidecars."""

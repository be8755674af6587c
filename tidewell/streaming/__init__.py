"""Structured Streaming forms of the windowed operators (an extension: captures are batch data)."""

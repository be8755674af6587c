"""Whole queries composed of operators: session processing, reports, and the registered queries."""

"""Column expressions: ordered-series helpers, unit conversion, scalar maths."""

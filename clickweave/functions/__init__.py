"""Column expressions: scalars, statistics and text helpers."""

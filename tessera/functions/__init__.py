"""Column expressions: paths, identifiers, rounding, import extraction."""

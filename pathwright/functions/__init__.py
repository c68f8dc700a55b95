"""Column functions: text, LaTeX, identifiers, JSON and arrays."""

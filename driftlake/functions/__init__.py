"""Column expressions: predicates, special functions, transforms and units."""

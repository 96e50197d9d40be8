"""Column-level functions: coordinates, pixels, predicates and their SQL names."""

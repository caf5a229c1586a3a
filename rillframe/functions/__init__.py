"""Column functions: optional values, results, tuples, collectors."""

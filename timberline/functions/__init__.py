"""Column functions: fields, tokens and predicates."""
